"""Operators of a training-data pipeline over documents and conversations.

Nothing else in the package imports this subpackage.
"""
