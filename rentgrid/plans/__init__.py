"""Registered queries; importing this package fills the registry."""

from rentgrid.plans import audits, cell_tables, flagship, listings, market, modelling, places, products, statistics  # noqa: F401
from rentgrid.plans.registry import ORACLE, QUERIES  # noqa: F401
