"""Readers, table loaders and sinks."""
