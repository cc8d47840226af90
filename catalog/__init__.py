"""Queries over the order tables and their SQL counterparts."""
