"""palimpsest: agent-memory analytics as Spark jobs."""
