"""Readers and writers: catalogue tables, image files, exports and scratch tables."""
