"""A PySpark-native columnar analytics engine."""
