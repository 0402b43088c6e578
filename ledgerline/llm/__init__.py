"""Operators for preparing training data: mixing, search, redaction, deduplication, archives, language."""
