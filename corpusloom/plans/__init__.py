"""Whole plans put together from operators, and the queries over the test tables."""
