"""Queries over the driver's tables. Importing the package fills the registry."""

from changelens.plans import (  # noqa: F401
    control_queries,
    embed_queries,
    evaluation_queries,
    git_queries,
    graph_queries,
    impact_queries,
    parse_queries,
    search_queries,
    store_queries,
    text_queries,
)
