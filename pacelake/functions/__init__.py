"""Column expressions of the domain: all JVM-side, none needs Python workers."""
