"""A Spark-native engine for knowledge retrieval, lifecycle and corpus preparation."""
