"""Eventloom: operators."""
