"""Matchers put together from the operators, views of the test tables, and the catalogue of queries."""
