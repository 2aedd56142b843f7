"""Relational operators with column-name parameters."""
