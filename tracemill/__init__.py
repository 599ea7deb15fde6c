"""Spark operators for building and auditing code-completion training tables."""
