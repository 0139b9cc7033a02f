"""Verdigris streaming."""
