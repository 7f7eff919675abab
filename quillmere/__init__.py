"""A PySpark-native engine for document retrieval and knowledge-graph analytics."""
