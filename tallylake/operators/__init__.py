"""Table operators: DataFrame in, DataFrame out, keyed by tenant."""
