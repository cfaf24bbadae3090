"""Named operators, and the catalogue of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from ..operators import chunkers, graph, html, retrieval, tables
from ..operators.windows import WindowConfig

CHUNKERS: dict[str, Callable] = {
    "text": chunkers.chunk_text, "pages": chunkers.chunk_pages, "paragraphs": chunkers.chunk_paragraphs, "markdown": chunkers.chunk_headings, "html": html.chunk_html,
    "sheet_rows": chunkers.chunk_rows, "sheet_columns": chunkers.chunk_columns, "sheet_cells": chunkers.chunk_cells, "hybrid": chunkers.chunk_hybrid, "images": chunkers.chunk_images, "image_pages": chunkers.chunk_image_pages, "tables": tables.tables_and_text,
}
RETRIEVERS: dict[str, Callable] = {"dense": retrieval.dense, "bm25": retrieval.bm25, "hybrid": retrieval.hybrid, "graph": graph.graph_retrieve, "mmr": retrieval.mmr, "rerank": retrieval.rerank, "compress": retrieval.compress, "heal": retrieval.heal}


def create(kind: str, name: str) -> Callable:
    known = {"chunker": CHUNKERS, "retriever": RETRIEVERS}[kind]
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def available(kind: str) -> list[str]:
    return sorted({"chunker": CHUNKERS, "retriever": RETRIEVERS}[kind])


def schema() -> list[dict]:
    """Windows' settings as rows of name, type and default."""
    return [{"name": f.name, "type": str(f.type), "default": f.default} for f in fields(WindowConfig)]
