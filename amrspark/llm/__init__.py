"""Operators that turn knowledge chunks into training data."""
