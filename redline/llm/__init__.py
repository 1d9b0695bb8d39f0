"""Operators for preparing training data: quality, language, mixing, search, deduplication, tokens, URLs, toxicity."""
