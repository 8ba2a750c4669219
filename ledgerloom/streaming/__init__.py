"""Rate, liveness and progress checks over event streams, for batch and for Structured Streaming."""
