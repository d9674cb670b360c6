"""PySpark-native analytics for single-cell chromatin-contact data."""
