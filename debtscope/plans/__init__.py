"""Pipelines that combine several operators."""
