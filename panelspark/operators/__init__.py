"""Operators: DataFrame(s) in, DataFrame out, lazy and keyed."""
