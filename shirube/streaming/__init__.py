"""Structured Streaming forms of the arrival, change-feed, job and queue operators."""
