"""Structured Streaming forms of the request, token and run flows."""
