"""Column expressions: number, text, JSON and rule helpers."""
