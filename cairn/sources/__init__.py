"""Sources and sinks: repository JSON, published generations, exports, metric lines."""
