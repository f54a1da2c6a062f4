"""All registered queries of the document operators."""

from __future__ import annotations

from . import q_assembly, q_batch, q_chunks, q_contracts, q_corpus, q_figures, q_headers, q_layout, q_lines, q_outputs, q_quality, q_retrieval, q_review, q_semantic, q_sources, q_tables, q_technical  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
