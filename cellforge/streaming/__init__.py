"""Statistics of values that arrive over time, by Structured Streaming."""
