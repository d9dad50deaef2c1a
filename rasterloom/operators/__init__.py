"""Operators of the displacement engine."""
