"""Batch and streaming Spark jobs for large photo catalogues and text corpora."""
