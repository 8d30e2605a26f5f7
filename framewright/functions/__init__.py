"""Column functions: labels, time axis, mathematics, strings and vectors."""
