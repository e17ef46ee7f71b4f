"""Duplicates among files that keep arriving."""
