"""Operators for large training-data corpora; see ``registry`` for the queries."""
