"""Operators for training-data pipelines on text and free-typed values; nothing outside imports this package."""
