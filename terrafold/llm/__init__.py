"""Operators for preparing large text corpora. Nothing else in the package imports this."""
