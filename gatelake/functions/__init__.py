"""Column expressions: text, ISO 6346, geometry and time."""
