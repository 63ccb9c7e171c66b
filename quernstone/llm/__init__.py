"""Training-data operators: extraction, filtering, deduplication, mixing, formatting.

Nothing outside this subpackage imports it, and it imports nothing of the rest
of the library, so either half can be used (or removed) alone.
"""
