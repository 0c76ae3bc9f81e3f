"""Event-aligned analytics on Spark."""
