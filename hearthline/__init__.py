"""Residential property-price analytics as PySpark DataFrame jobs."""
