"""Catalog intelligence on Spark: database catalogs treated as data."""
