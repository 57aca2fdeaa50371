"""Catalogue, graph and diagnostics operators."""
