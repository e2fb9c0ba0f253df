"""End-to-end jobs composed from the operators, and shared plan helpers."""
