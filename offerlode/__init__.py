"""Offer mining on Spark: find, score, deduplicate and report shopping offers."""

__all__ = ["functions", "operators", "plans", "queries", "sinks", "sources", "streaming"]
