"""Operators over node tables."""
