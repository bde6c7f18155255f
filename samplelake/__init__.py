"""PySpark-native analytics over sample-library metadata."""
