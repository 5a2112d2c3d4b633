"""Operators: DataFrame in, DataFrame out. None of them collects rows."""
