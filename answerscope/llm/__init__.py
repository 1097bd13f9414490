"""Operators for training-data pipelines, each in a module of its own; nothing else in the library imports them."""
