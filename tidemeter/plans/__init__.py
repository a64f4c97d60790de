"""Named queries over the supplied tables."""

from tidemeter.plans import flow, inference, models, scalars, storage, streams  # noqa: F401
from tidemeter.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
