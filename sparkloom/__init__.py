"""Spark-first duplication, structure and change analytics."""
