"""PySpark-native analytics toolkit."""
