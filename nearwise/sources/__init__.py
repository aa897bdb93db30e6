"""Readers and writers for record tables and vector tables."""
