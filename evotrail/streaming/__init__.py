"""The change feed as Structured Streaming queries."""
