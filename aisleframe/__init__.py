"""Retail scanner panels and multi-state tax apportionment as PySpark DataFrame operators."""
