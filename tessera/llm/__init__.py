"""Operators for training-data pipelines; nothing else in tessera imports them."""
