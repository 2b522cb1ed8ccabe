"""Offer registry jobs for Spark: collect, merge, expire, serve and report keyed offers."""
