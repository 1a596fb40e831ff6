"""Stateful and windowed operators over frames."""
