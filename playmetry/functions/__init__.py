"""Column expressions; all are native Spark SQL, usable in batch and streaming."""
