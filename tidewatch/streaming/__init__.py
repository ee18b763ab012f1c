"""The same jobs on Structured Streaming."""
