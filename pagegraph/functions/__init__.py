"""Column functions of the layout engine (JVM-side expressions)."""
