"""Structured Streaming over a growing attempt log."""
