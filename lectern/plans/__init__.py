"""Registered queries; importing a module of this package registers those in it."""

from lectern.plans import chunking, dashboards, pages, requirements, retrieval, streaming, workspace
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunking", "dashboards", "pages", "requirements", "retrieval", "streaming", "workspace"]
