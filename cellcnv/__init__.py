"""Single-cell copy-number analysis as Spark jobs."""
