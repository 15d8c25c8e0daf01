"""Whole jobs, and the queries that bind operators to tables."""
