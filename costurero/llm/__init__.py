"""Operators that prepare documents and pages as training data."""
