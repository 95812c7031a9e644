"""Spark-first sparse × dense analytics."""
