"""Column helpers: each builds a Spark ``Column`` and stays on the JVM unless noted."""
