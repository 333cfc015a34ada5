"""Change feeds and event streams as Structured Streaming jobs."""
