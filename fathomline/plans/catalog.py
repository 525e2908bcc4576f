"""All registered queries."""

from . import (catalog_draw, catalog_grids, catalog_keys, catalog_labels, catalog_model,  # noqa: F401
               catalog_rates, catalog_sessions)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
