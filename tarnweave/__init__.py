"""A Spark-native engine for document knowledge pipelines."""
