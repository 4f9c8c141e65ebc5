"""Import every query module, so that each registers its queries."""

from workload import (  # noqa: F401
    alignment_queries,
    catalog_queries,
    check_queries,
    divergence_queries,
    feature_queries,
    source_queries,
    stream_queries,
    trait_queries,
    window_queries,
)
