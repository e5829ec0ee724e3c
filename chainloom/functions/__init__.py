"""Contract-event analytics on Spark."""
