"""tracewell: a PySpark-native engine for call-graph, log-event and batch dataflow analytics."""
