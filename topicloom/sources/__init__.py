"""Readers of landed payloads and run history; append sinks."""
