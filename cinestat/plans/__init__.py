"""Registered queries; importing a module registers what it defines."""

from cinestat.plans import boosting, chains, detections, distributions, fits, geometry, imaging, learning, relational, tabular, warps
from cinestat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
