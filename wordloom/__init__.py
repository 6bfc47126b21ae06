"""A Spark-native engine for subword encodings of text columns."""
