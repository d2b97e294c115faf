"""Operators that prepare text, vectors and web pages for model training."""
