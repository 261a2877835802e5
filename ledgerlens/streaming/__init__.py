"""Structured Streaming jobs: the incremental form of the load and clean steps."""
