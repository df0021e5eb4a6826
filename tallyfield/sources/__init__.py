"""Readers of workbooks, tables and content files."""
