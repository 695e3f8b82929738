"""Folioforge: refine large text collections as Spark DataFrame jobs."""
