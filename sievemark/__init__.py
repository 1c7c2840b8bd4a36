"""PySpark-native research-data integrity analytics."""
