"""Readers and writers of feeds, tables, documents and results."""
