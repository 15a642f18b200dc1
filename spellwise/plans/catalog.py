"""All named queries."""

from spellwise.plans import queries_files, queries_models, queries_states, queries_survival, queries_tables  # noqa: F401
from spellwise.plans.registry import ORACLES, QUERIES  # noqa: F401
