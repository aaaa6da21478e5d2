"""Subpackage of the statement engine."""
