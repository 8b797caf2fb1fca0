"""Training-data operators: deduplication, search, quality, secrets, tokenizing, packing and binary output.

Nothing outside this package imports it.
"""
