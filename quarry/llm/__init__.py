"""Operators for large text corpora: filters, de-duplication, scoring, mixing, search and token encoding."""
