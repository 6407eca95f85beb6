"""Payment-conversion monitoring as Spark DataFrame and streaming jobs."""
