"""Sequence-graph analytics and training-data preparation as Spark jobs."""
