"""Whole queries, their survey views and the SQL they are checked against."""
