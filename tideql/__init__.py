"""tideql: a Spark-native streaming SQL rules engine."""
