"""Operators for large training-data pipelines, each by one named method."""
