"""Queries of the training-data operators."""

from __future__ import annotations

from millrace.llm import bpe, endings, format_copies, mixing, near_copies, neighbours, pairs, quantiles, spans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (pairs, endings, quantiles, neighbours, format_copies, near_copies, bpe, mixing, spans):
    QUERIES |= module.QUERIES
    ORACLES |= getattr(module, "ORACLES", {})
