"""Readers that turn files into tables of lines."""
