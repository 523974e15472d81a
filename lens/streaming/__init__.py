"""Endless sources."""
