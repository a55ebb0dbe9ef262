"""Joins, groupings and rankings over catalogue tables."""
