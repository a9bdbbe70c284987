"""marginalia: Spark-native analytics for reading communities."""
