"""The row functions under Structured Streaming."""
