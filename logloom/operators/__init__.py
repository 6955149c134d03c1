"""Operators on tables of lines."""
