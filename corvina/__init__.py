"""A Spark-native engine for routing, retrieval, curation and monitoring of text and interaction logs."""
