"""Similarity analytics as DataFrame transformations."""
