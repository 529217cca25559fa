"""Token streams and pacing as Structured Streaming."""
