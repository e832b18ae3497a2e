"""Markdown corpora: reading, chunks by heading, and retrieval by character n-grams."""
