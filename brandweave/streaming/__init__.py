"""Windowed counts, sessions, attribution and spikes over event streams."""
