"""Structured Streaming entry points of the batch operators."""
