"""Whole queries: parsing, search, evaluation, and the registered ones."""
