"""Log diagnosis on Spark."""
