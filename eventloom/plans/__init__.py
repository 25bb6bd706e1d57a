"""Registered plans."""

from . import analytics, library, readers, reading, relational, sessions, suite  # noqa: F401
from .registry import QUERIES, SQL, Tables, query  # noqa: F401
