"""Operators over point sets."""
