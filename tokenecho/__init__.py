"""Token-reuse analytics on Spark."""
