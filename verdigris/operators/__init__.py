"""Verdigris operators."""
