"""Expressions: trees, their text form, type checks, and their compilation to columns."""
