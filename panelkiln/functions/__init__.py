"""Column helpers, statistics, splits and retrieval."""
