"""Complaint analytics expressed as Spark DataFrame jobs."""

__all__ = ["constants", "session", "functions", "operators", "plans", "sources", "streaming"]
