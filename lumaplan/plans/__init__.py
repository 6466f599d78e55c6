"""Queries over the codec's operators, and the SQL that says the same."""
