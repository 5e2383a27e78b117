"""Composed plans: the tenant catalog, its queries, and their SQL twins."""
