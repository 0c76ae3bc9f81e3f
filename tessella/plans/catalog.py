"""All queries of the engine."""

from tessella.plans import q_events, q_groups, q_models, q_more, q_pairs, q_series, q_stats  # noqa: F401
from tessella.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
