"""Column functions: every one is built from JVM-side Spark expressions."""
