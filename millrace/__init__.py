"""Analytics operators for Spark DataFrames: text, search, topics, profiling and classification."""

__version__ = "0.1.0"
