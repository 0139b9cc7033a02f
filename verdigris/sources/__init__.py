"""Verdigris sources."""
