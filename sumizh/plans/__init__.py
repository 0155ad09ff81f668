"""Named queries over a data folder, and their SQL."""

from sumizh.plans import core_problems, documents, entities, graphs, lines, pairs, panels, records, resolution, storage, vectors  # noqa: F401
from sumizh.plans.registry import registry

__all__ = ["registry"]
