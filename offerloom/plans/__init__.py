"""Whole runs: collect offers into the registry, look hosts up in it."""
