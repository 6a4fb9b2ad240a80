"""A Spark-native engine for preparing, cross-referencing and validating listing tables."""
