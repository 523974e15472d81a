"""Lexing, parsing and binding."""
