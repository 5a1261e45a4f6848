"""tidepanel: snapshot-panel analytics as plain Spark DataFrame jobs."""
