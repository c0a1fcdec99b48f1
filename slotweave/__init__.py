"""Keyed analytics on Spark: command logs replayed into typed tables, and the queries that run on them."""
