"""Operators on text and on records without keys; nothing outside imports it."""
