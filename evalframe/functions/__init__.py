"""Column-level functions (JVM-side expressions) and the few Arrow-batched
pandas UDFs that Spark SQL has no built-in for (distribution functions)."""
