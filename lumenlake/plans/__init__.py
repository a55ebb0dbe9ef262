"""Registered queries and the catalogue views they run on."""
