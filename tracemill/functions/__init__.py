"""Column-level functions: each takes and returns ``Column`` and stays inside the row."""
