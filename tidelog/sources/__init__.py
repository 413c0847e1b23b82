"""Readers, file manifest and the stored table."""
