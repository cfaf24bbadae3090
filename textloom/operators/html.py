"""HTML pages to text nodes and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .windows import WindowConfig, spans

# Elements that make a node, elements without content, and elements that hold no prose.
SPLIT_TAGS = ("p", "article", "section", "div", "li", "td", "th", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "code")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "noscript"))


class _Nodes(HTMLParser):
    """Text pieces, and for each element of interest the range of pieces that it holds."""

    def __init__(self, tags: frozenset[str], strip: bool):
        super().__init__(convert_charrefs=True)
        self.tags, self.strip, self.pieces, self.open, self.found, self.silent = tags, strip, [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append((tag, len(self.pieces), len(self.found)))
        if tag in self.tags:
            self.found.append([tag, len(self.pieces), None])
        self.silent += self.strip and tag in SILENT

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        while at is not None and len(self.open) > at:
            name, _, k = self.open.pop()
            if name in self.tags:
                self.found[k][2] = len(self.pieces)
            self.silent -= self.strip and name in SILENT

    def handle_data(self, data):
        if not self.silent and (text := data.strip()):
            self.pieces.append(text)

    def nodes(self) -> list[tuple[str, str]]:
        out = [(tag, " ".join(self.pieces[a : len(self.pieces) if b is None else b])) for tag, a, b in self.found]
        return [x for x in out if x[1]]


def page_nodes(html: str, tags: tuple[str, ...] = SPLIT_TAGS, strip: bool = True, document_order: bool = False) -> tuple[list[tuple[str, str]], str]:
    """(tag, text) of each element of interest, tag by tag in the given order or in document order; and all text."""
    parser = _Nodes(frozenset(tags), strip)
    parser.feed(html)
    parser.close()
    found = parser.nodes()
    return found if document_order else sorted(found, key=lambda x: tags.index(x[0])), " ".join(parser.pieces)


def chunk_html(pages: DataFrame, c: WindowConfig = WindowConfig(), tags: tuple[str, ...] = SPLIT_TAGS, strip: bool = True, document_order: bool = False) -> DataFrame:
    """(doc_id, html) to (doc_id, chunk_index, text, tags): nodes are gathered while their words fit into c.size, a larger
    node stands alone, and each gathering is windowed; a page without nodes is windowed whole. Nested elements repeat
    their text in each of their ancestors of interest."""

    def chunks(html: str) -> Iterator[tuple[str, str]]:
        nodes, whole = page_nodes(html, tags, strip, document_order)
        bins, size = [], 0
        for tag, text in nodes or [("", whole)]:
            n = len(text.split())
            if not bins or size + n > c.size:
                bins.append(([], []))
                size = 0
            bins[-1][0].append(text)
            bins[-1][1].append(tag)
            size += n
        for texts, names in bins:
            tokens = " ".join(texts).split()
            for a, b in spans(tokens, c):
                yield " ".join(tokens[a:b]), ",".join(dict.fromkeys(names))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(i, k, *x) for i, html in enumerate(batch.column(1).to_pylist()) for k, x in enumerate(chunks(html or ""))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *made], names=["doc_id", "chunk_index", "text", "tags"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "html").mapInArrow(run, f"doc_id {kind}, chunk_index int, text string, tags string")
