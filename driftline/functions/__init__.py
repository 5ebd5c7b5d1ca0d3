"""Column expressions that the operators and queries share."""
