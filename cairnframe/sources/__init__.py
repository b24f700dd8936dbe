"""Readers of trees, reports and stored tables."""
