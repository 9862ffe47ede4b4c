"""Operators that prepare large text and sequence collections for model training."""
