"""Column functions and argument checks."""
