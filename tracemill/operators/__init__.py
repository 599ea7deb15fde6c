"""DataFrame operators, composed with ``DataFrame.transform``."""
