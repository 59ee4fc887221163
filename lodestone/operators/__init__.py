"""Operators over sources and findings; DataFrame in, DataFrame out."""
