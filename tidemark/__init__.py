"""A Spark-native pipeline engine for records that arrive late, get amended and change over time."""
