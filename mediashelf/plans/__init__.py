"""Composed plans: search, and the library views over the driver tables."""
