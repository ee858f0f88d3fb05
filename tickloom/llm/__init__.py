"""Operators of a training-data pipeline, one module each; ``registry`` has their queries and SQL."""
