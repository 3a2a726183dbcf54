"""Spark-first analytics over web-text corpora."""
