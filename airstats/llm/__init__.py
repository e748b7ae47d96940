"""Operators for the preparation of training data; nothing else in the package imports them."""
