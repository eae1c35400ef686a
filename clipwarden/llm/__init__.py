"""Operators for large training corpora: cleaning, search, mixing and output."""
