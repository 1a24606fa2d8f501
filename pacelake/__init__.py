"""Point-in-time analytics on Spark: leakage-safe features, as-of joins, evaluation and decisions."""
