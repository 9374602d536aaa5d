"""Readers and snapshot tables."""
