"""Operators for training-data pipelines, each by one named method."""
