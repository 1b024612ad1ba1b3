"""Column expressions.  Everything here is JVM-side; no Python runs per row."""
