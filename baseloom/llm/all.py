"""Import every operator module, so that each registers its query."""

from baseloom.llm import (  # noqa: F401
    html_text,
    jaccard_join,
    lexical_search,
    licenses,
    line_dedup,
    mixing,
    nn_graph,
    packing,
    periodic_runs,
    pii,
    quality_net,
    quality_rules,
    token_store,
)
