"""Expressions as Spark columns."""
