"""jobtext — job-text analytics as Spark DataFrame, ML and streaming jobs."""
