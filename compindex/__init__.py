"""compindex: composite indicators as Spark DataFrame jobs."""
