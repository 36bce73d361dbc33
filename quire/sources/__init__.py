"""Sources: the given parquet tables, derived stand-in inputs, and file scans."""
