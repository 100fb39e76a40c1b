"""Whole dataflows: building an index, answering a batch of queries, serving chat."""
