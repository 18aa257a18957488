"""skupulse.streaming."""
