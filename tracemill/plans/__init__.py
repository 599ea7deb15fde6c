"""Named queries over the given tables, each with a SQL twin where SQL can say it."""
