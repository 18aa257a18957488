"""skupulse.operators."""
