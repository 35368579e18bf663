"""Incremental state over streams of transactions."""
