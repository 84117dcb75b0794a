"""sparkloom: a Spark-native analytics engine (DataFrame, SQL and Structured Streaming)."""
