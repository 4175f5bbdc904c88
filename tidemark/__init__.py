"""Spark-native analytics over versioned key-value data and a usage ledger."""
