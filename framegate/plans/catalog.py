"""Importing this module registers every query."""

from framegate.plans import (  # noqa: F401
    q_boards, q_cascade, q_evaluation, q_features, q_filters, q_geometry, q_graph, q_joins, q_keys, q_metrics, q_ranking, q_sources, q_spatial,
    q_streaming,
)
