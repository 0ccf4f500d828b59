"""Column-level functions: built-in Spark expressions, plus one Arrow UDF for JSON of unknown depth."""
