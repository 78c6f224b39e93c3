"""Catalog analytics on Spark: search, recommendation, duplicates, pricing, enrichment and usage."""
