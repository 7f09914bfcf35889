"""Readers, split planning, sinks."""
