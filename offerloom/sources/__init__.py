"""Readers and writers of captures, feeds, sitemaps, Markdown pages, registries, reports and runs."""
