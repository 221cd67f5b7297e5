"""Operators for preparing training data: quality, secrets, duplicates, language, tokens, mixing."""
