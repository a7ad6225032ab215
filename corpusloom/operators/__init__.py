"""Operators: DataFrame in, DataFrame out, lazily, and without state on the driver."""
