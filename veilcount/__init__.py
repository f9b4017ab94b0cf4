"""Private event counting on Spark."""
