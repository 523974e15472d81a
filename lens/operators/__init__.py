"""Logical nodes as DataFrames."""
