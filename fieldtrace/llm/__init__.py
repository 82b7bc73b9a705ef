"""Operators over text corpora: scoring, language, tokens, mixing, duplicates, sharding, leaks and vector search."""
