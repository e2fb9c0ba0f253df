"""Relational operators on observation rows."""
