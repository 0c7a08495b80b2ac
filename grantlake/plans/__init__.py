"""Statement tables and the registered queries."""


def load_queries():
    """All registered queries, their comparison SQL and what they cover."""
    from . import queries_items, queries_rules, queries_analysis  # noqa: F401
    from .registry import COVERS, ORACLES, QUERIES

    return QUERIES, ORACLES, COVERS
