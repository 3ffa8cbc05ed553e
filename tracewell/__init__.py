"""Tracewell: document and evidence analytics as PySpark DataFrame operators."""
