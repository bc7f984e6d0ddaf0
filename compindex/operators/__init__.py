"""Relational operators over DataFrames of any size."""
