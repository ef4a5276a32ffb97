"""Operators: DataFrame in, DataFrame out, no collect inside."""
