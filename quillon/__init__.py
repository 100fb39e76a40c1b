"""Spark-first retrieval, extractive answering and corpus preparation."""
