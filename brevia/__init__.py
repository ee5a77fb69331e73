"""Text compression and usage analytics on Spark."""
