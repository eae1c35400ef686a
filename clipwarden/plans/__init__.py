"""Registered queries over the driver's tables, with presets and grids."""


def load():
    """All registered queries and their reference SQL."""
    from . import (  # noqa: F401
        curation_queries, feature_queries, heldout_queries, mart_queries, signal_queries, source_queries, stream_queries, track_queries,
    )
    from .registry import QUERIES, SQL

    return QUERIES, SQL
