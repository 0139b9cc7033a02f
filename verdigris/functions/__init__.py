"""Verdigris functions."""
