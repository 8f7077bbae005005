"""Operators: design, Gram, projection, search, evaluation and statistics."""
