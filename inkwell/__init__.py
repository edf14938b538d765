"""Grounded question answering over document collections, as Spark jobs."""
