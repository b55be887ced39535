"""Operators for large training-data corpora: packing, near and exact
deduplication, mixing, PII, toxicity, secrets, web archives, exact vector
search and passage deduplication.  Nothing outside this package imports it."""
