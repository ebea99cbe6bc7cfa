"""Distinctive-term extraction over document collections, as Spark DataFrame operations."""
