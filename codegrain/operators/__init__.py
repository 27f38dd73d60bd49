"""Operators on records and corpora."""
