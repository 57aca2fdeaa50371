"""Readers, writers and the product cache."""
