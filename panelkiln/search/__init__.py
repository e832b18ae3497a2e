"""Typed genetic search for rules, with batched evaluation on Spark."""
