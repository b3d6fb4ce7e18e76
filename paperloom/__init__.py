"""Spark-first scholarly search analytics."""
