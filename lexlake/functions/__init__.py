"""Column expressions shared by the operators. Nothing here leaves the JVM."""
