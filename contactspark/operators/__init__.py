"""Operators over contacts, maps and tracks: DataFrame in, DataFrame out."""
