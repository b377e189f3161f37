"""Column expressions with fixed null, NaN and division rules."""
