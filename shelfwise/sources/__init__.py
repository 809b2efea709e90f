"""Scans, stand-in views and writers (SRC-01..03)."""
