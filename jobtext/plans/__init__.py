"""Named queries (one per operator of the coverage list) and their oracles."""

from jobtext.plans import curate_queries, eval_queries, history_queries, match_queries, ml_queries, request_queries, stream_queries, window_queries  # noqa: F401
from jobtext.plans.registry import ORACLE, QUERIES  # noqa: F401
