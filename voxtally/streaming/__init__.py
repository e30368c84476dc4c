"""The row-wise stages on a Structured Streaming source."""
