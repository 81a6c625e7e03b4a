"""Formula tables."""
