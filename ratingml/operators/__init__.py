"""DataFrame-to-DataFrame operators and Spark ML stages."""
