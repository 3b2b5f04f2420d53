"""Column-expression helpers for dates and display text."""
