"""Structured Streaming over points."""
