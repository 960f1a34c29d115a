"""paperloom: a Spark-native engine for building, searching and evaluating corpora of papers."""

__version__ = "0.1.0"
