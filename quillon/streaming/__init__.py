"""Stateful chat operators over Structured Streaming."""
