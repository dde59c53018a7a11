"""Operators over DataFrames with well-defined input columns."""
