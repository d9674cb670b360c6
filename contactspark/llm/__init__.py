"""Operators for large-scale training-data pipelines; nothing else in the package imports them."""
