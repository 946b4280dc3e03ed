"""PySpark-native analytics over daily market bars."""
