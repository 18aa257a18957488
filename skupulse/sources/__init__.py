"""skupulse.sources."""
