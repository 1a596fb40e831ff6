"""Readers and writers for label, annotation and log formats."""
