"""Parsers of stored feeds, pages, JSON and CSV."""
