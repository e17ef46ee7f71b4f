"""Query families: reports, matches of two sides, keep-newest, and disposal plans."""
