"""Structured Streaming forms of the sources that grow."""
