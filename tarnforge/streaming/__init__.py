"""Structured Streaming equivalents."""
