"""Scalar functions: analysis, stemming, hashing, URLs, snippets."""
