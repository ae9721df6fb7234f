"""Operators on long tables of fields and observations."""
