"""Spark jobs for large libraries of rehearsal recordings and for text corpora."""
