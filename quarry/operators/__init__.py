"""Operators of the utility mining engine."""
