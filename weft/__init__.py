"""weft: a Spark-native data integration engine."""

__version__ = "0.1.0"
