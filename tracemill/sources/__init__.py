"""Reading and publishing tables."""
