"""Operators for text-corpus preparation; nothing outside this subpackage imports it."""
