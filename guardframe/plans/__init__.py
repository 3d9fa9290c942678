"""Registered queries with the SQL that they are checked against."""
