"""cueline: a Spark-native engine for corpora of timed text lines."""
