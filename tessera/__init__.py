"""Coalition analytics on Spark: who contributed how much to a result."""
