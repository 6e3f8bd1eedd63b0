"""Structured Streaming forms of the repeated batch jobs."""
