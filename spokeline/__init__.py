"""spokeline: a Spark-native engine for street-network tables and large-scale data preparation."""

__version__ = "0.1.0"
