"""Incremental forms of the batch statistics."""
