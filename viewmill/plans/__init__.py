"""Registered queries: each plan binds operators to the given tables."""
