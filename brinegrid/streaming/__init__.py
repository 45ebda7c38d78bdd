"""Streams of route requests."""
