"""Registered queries: each pairs a Spark build with the SQL that must give the same rows."""

from ebbtide.catalog import (  # noqa: F401
    features,
    general,
    modelling,
    targets,
)
from ebbtide.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
