"""Readers, stage tables and sinks."""
