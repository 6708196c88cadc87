"""Daily panel analytics on Spark."""
