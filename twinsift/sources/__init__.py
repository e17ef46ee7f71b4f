"""Where file relations come from: flat folders, tables with content, and index files."""
