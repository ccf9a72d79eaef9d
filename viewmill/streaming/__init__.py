"""Structured Streaming operators of the step protocol."""
