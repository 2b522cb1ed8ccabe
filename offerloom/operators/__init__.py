"""Jobs that turn one DataFrame into another."""
