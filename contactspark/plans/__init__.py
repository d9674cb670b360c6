"""Registered queries over the test tables, with their SQL."""
