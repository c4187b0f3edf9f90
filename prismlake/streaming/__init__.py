"""Streams of job events."""
