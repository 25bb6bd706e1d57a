"""Eventloom: sources."""
