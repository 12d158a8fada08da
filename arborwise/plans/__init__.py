"""Pipelines, reasoner and catalog."""
