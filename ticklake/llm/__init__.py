"""Operators that prepare training text: deduplication, quality, language,
tokenisation, packing and HTML extraction.  Nothing outside this folder imports it."""
