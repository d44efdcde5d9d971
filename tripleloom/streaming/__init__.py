"""Structured Streaming flows over the batch operators."""
