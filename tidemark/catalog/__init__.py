"""Runnable queries over the driver tables, and the SQL that checks them."""

from . import (  # noqa: F401
    base_ops,
    detectors,
    flagship,
    labels,
    metafeatures,
    pairs_streams,
    profiles,
    quality,
    relational,
    selection,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
