"""Operators for preparing language-model training data, all of them Spark jobs."""
