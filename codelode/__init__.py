"""A PySpark-native engine for code and document corpora."""
