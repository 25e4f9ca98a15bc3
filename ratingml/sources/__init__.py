"""Readers and writers of tables, feature files and fitted models."""
