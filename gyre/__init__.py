"""A PySpark-native analytics engine for text corpora and the telemetry around them."""
