"""Columnar analytics on Spark: managed tables, layout maintenance, interchange and SQL parity."""

__version__ = "0.1.0"
