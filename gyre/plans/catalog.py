"""All queries of the engine's own operators, by name, with their SQL."""

from gyre.plans import answers, machines, reading, relational, search, sources, telemetry, text, tutoring, vectors, streams  # noqa: F401  these register themselves
from gyre.plans.registry import oracle_sql, queries

FLAGSHIP = "k1_vector_topk"

__all__ = ["FLAGSHIP", "oracle_sql", "queries"]
