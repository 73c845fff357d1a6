"""All named queries: importing the modules fills the registry."""

from . import basics, graphs, mining, streams  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
