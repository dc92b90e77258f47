"""Operators of a training-data pipeline; see ``registered`` for the queries."""
