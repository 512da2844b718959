"""stillpoint: a Spark-native engine for ordered sample streams and their evidence."""

__version__ = "0.1.0"
