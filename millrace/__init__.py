"""A Spark-native engine for declarative data pipelines."""
