"""Incremental runs over directories that keep receiving files."""
