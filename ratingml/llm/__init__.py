"""Operators for building training text: filters, extraction, near duplicates, tokens.

Nothing outside this subpackage imports it. Queries are registered in ``queries``.
"""
