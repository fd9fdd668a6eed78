"""matchlens: match analytics as Spark jobs."""
