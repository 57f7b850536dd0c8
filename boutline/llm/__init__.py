"""Operators of a training-data pipeline, and their registered queries."""
