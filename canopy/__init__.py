"""Canopy: a directory query engine written as Spark DataFrame programs."""
