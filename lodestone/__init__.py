"""A PySpark-native engine for typed tables with constraints."""
