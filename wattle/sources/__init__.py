"""Sources: fixtures derived from the given tables, and text/parquet readers and writers."""
