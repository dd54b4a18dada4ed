"""Structured Streaming over changed files."""
