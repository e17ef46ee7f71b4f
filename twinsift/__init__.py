"""twinsift: exact-duplicate analytics over files and content-bearing tables, written for Spark's Catalyst."""
