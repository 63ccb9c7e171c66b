"""Readers and the versioned sink."""
