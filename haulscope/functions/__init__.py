"""Column expressions. Everything here stays inside JVM code generation."""
