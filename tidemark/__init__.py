"""A Spark-native engine for communication, document and knowledge-graph analytics."""
