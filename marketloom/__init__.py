"""marketloom: a Spark-native analytics engine for market and event time series."""

__version__ = "0.1.0"
