"""weftline: a Spark-native engine for visual dataflow workflows and corpus preparation."""
