"""Graph streaming."""
