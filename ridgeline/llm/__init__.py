"""Operators for training-data pipelines.

One module per operator; ``queries`` and ``oracle`` register them. Nothing in the
rest of the library imports this subpackage.
"""
