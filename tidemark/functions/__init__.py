"""Column expressions: no Python UDFs, everything stays in generated code."""
