"""sedge: a Spark-native analytics engine for source trees, logs and development history."""
