"""Readers and document parsers."""
