"""A PySpark-native engine for change-impact analytics."""
