"""The query catalogue: importing it registers every query."""

from gradframe.catalog import (  # noqa: F401
    analysis,
    arithmetic,
    logs,
    networks,
    preparation,
    prioritised,
    training,
)
from gradframe.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
