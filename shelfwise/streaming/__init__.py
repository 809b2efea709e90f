"""Structured Streaming jobs (STR-01..07) and their runner."""
