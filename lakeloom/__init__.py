"""A Spark-native engine for conversation logs and text corpora."""
