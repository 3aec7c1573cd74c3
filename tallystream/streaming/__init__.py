"""Structured Streaming faces of the reducers."""
