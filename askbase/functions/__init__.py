"""Column expressions (all JVM-side unless the name says otherwise)."""
