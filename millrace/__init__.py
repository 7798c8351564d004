"""Change-log analytics on Spark."""
