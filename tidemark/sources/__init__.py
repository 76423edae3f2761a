"""Readers, parsers and writers of points."""
