"""Structured Streaming front ends (an extension; the batch operators come first)."""
