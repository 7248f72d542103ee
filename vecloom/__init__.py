"""vecloom - a PySpark-native engine for annotated text and vector-valued columns."""
