"""Coffer: ZIP archives as distributed datasets on Apache Spark."""
