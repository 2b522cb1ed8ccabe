"""Column expressions of the offer rules; everything here stays inside the JVM."""
