"""waybill: a Spark-native analytics engine for prompt-routing data."""
