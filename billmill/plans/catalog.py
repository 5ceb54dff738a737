"""Importing this module registers every named query."""

from billmill.plans import (  # noqa: F401
    asking,
    checking,
    comparing,
    filing,
    flowing,
    reading,
    registering,
    scalars,
    searching,
)
from billmill.plans.registry import QUERIES

__all__ = ["QUERIES"]
