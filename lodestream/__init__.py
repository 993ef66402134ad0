"""A Spark-native engine for streams of published documents."""
