"""Stateless queries over streams of events."""
