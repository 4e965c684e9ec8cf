"""Column functions on hierarchical names."""
