"""Import side effects register every plan."""

from . import amm_queries, catalogue_queries, ledger_queries, price_queries, stream_queries, trace_queries, view_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
