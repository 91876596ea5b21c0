"""Operators for training data that are tagged llm. Nothing else in the library imports this package."""
