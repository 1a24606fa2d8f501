"""Readers: nested documents to flat rows, with declared schemas and no inference pass."""
