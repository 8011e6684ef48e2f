"""A Spark-native engine for interval, sequence, score and motif tables."""
