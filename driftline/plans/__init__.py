"""Whole comparisons as one plan, and the scratch tables that long plans write."""
