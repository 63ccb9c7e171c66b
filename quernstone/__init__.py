"""A Spark-native engine for semantic retrieval, signal analytics and training-data preparation."""
