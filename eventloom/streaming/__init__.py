"""Eventloom: streaming."""
