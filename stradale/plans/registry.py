"""All queries of the road-network operators, and their SQL oracles."""

from __future__ import annotations

from stradale.plans import queries
from stradale.plans.oracles import ORACLES

_EXTRA = ("skeletonize", "occlude_tiles", "single_effects", "positive_sampling")
QUERIES = {name: getattr(queries, name) for name in (*ORACLES, *_EXTRA)}
