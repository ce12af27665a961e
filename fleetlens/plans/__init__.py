"""Registered queries over the driver's tables, by family."""

from fleetlens.plans.registry import QUERIES, Tables, query  # noqa: F401


def load_all() -> dict:
    """Import every family and return name -> (function, oracle SQL or None)."""
    from fleetlens.plans import (  # noqa: F401
        catalog_queries,
        check_queries,
        digest_queries,
        filter_queries,
        lifecycle_queries,
        report_queries,
        source_queries,
        stream_queries,
        text_queries,
    )

    return QUERIES
