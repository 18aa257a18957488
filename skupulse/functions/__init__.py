"""skupulse.functions."""
