"""Coded byte streams and JSON as Spark column functions, sources and streams."""
