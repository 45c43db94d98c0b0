"""Structured Streaming wrappers around the polling jobs."""
