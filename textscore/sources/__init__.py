"""Readers, writers and shared working tables."""
