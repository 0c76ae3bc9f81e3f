"""Operators over DataFrames; columns are named by arguments."""
