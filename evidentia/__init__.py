"""A PySpark-native analytics engine for an evidence-backed knowledge base."""
