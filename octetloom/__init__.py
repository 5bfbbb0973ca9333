"""A Spark-native engine for exploring bytes, records and event tables."""
