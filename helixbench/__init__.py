"""Variant-effect and structure benchmarking as Spark DataFrame operations."""
