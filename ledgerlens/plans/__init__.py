"""Composite plans, the query catalog and the model registry."""
