"""Eventloom: functions."""
