"""foliant: a PySpark-native engine for long-form text and timed media transcripts."""
