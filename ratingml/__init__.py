"""Learning from ratings data with Spark: clean, split, featurize, train, score."""

__version__ = "0.1.0"
