"""Readers and writers for the fact tables."""
