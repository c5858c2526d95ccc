"""Operators that prepare training text: quality, extraction, deduplication, secrets,
language, decontamination, vector search, mixing and token output."""
