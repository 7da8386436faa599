"""Training-data operators: search, mixing, language, duplicates, quality, tokens and personal data.

Nothing outside this subpackage imports it.
"""
