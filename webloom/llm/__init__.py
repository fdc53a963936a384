"""Operators of a training-data pipeline: language id, BPE, PII, near-duplicates, mixing, chat formatting,
language-model scoring, vector search and URL filtering. Nothing else in the library imports this package."""
