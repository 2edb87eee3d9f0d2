"""A Spark-native engine for retrieval and corpus analytics."""
