"""Operators over documents and the inverted index."""
