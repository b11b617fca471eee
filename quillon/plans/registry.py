"""All queries of the library, by name, with their SQL twins."""

from quillon.plans import arrivals, catalog, dense, fusion, fuzzy, graph, lexical, ingest, rules, scalars, search, seeding, service, stateful, telemetry, upkeep, vectors  # noqa: F401
from quillon.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
