"""Column expressions. Nothing here leaves the JVM at run time."""
