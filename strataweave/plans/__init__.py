"""Registered queries over the given tables, and the SQL that they are checked against."""
