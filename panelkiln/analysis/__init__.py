"""Fronts across runs, reports, and what to be suspicious of."""
