"""Operators for training-data pipelines; nothing else in spanmill imports them."""
