"""Registered queries: the operators applied to whole given tables."""
