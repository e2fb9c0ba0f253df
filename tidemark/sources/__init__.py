"""Readers and normalisers from provider exports to observation rows."""
