"""loomwork: agent-memory analytics as PySpark DataFrame jobs."""
