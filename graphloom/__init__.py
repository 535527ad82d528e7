"""A Spark-native engine for multimodal knowledge graphs."""
