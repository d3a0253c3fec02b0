"""Operators of a training-data pipeline: one module each, no other package imports them."""
