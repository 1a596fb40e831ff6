"""Relational operators over boxes, records, runs and streams of tracks."""
