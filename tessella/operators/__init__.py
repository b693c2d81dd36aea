"""Operators of the core engine."""
