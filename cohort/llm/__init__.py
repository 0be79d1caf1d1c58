"""Operators of a training-data pipeline (one module each); queries are in ``queries.py``."""
