"""Operators wired to the input tables of a data directory."""
