"""Structured Streaming pipelines over change journals and directory changes."""
