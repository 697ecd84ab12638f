"""Spark jobs for wildfire data preparation, retrieval, evaluation and simulation."""
