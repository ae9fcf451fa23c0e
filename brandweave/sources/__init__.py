"""Inputs: the given tables and the small tables that the caller supplies."""
