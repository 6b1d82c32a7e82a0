"""Quire: document-extraction analytics on Spark."""
