"""All registered queries of the engine's own operators."""

from folioforge.plans import catalog, questions, replies, safety, search, sessions, statistics, storage, text  # noqa: F401
from folioforge.plans.registry import ORACLE, QUERIES  # noqa: F401
