"""The registered queries over the given tables, and the same results in SQL."""
