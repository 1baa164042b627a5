"""Operators of a training-data pipeline, each on Spark by its own method."""
