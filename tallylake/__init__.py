"""Retail lakehouse and run-incident analytics as plain Spark DataFrame operators."""
