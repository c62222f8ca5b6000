"""Operators a training-data pipeline needs, each a Spark job over whole tables.

Nothing else in the library imports this package.
"""
