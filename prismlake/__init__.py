"""prismlake: Spark-native analytics for multi-view geometry tables and text corpora."""
