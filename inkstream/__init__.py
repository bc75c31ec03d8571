"""Narration-text and signal analytics as Spark jobs."""
