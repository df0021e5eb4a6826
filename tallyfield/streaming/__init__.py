"""Continuous forms of the stored-table operators."""
