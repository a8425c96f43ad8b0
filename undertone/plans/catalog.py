"""All registered queries."""

from undertone.plans import ingest, monitoring, opinions, retrieval  # noqa: F401
from undertone.plans.registry import ORACLES, QUERIES  # noqa: F401
