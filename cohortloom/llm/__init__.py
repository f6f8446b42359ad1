"""Operators on texts and typed-in values. Nothing else in the library imports this package."""
