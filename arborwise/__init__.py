"""Turns semi-structured documents into clean records with Spark DataFrames."""
