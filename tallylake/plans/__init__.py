"""Compositions of operators: the gold tables and the bronze -> silver -> gold run."""
