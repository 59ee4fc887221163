"""Re-scan triggers over event streams, in batch and Structured Streaming."""
