"""A Spark-native engine for customer profiles and subspace clustering."""
