"""Operators on text collections; nothing outside this package imports it."""
