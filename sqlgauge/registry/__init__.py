"""Named queries over the standard tables, each with the SQL that checks it."""

from . import latency, matching, prompts, reports, sequences  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
