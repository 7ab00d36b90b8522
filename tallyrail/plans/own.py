"""All queries of the engine's own operators; importing this module registers them."""

from tallyrail.plans import audits, checks, lifecycle, lookups, reports, rounds, runs, selections, texts  # noqa: F401
from tallyrail.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
