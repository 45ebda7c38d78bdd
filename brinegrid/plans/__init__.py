"""Whole plans: fixtures, queries and the batch route."""
