"""Operators that prepare training text and vectors at scale."""
