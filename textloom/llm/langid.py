"""Language identification by a byte convolutional network over fixed-length windows.

Filters of several widths, max pooling over the window and a softmax, trained with numpy on a bounded sample of
labelled windows; a task then scores all windows of its texts in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hash_sample

WINDOW = 256


@dataclass
class ByteNet:
    """embed: (256, e); for each width w, filters (w * e, f) and bias (f); out: (sum of f, classes) and its bias."""

    languages: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, what a byte adds to the filters at each place; two places share a table of byte pairs."""
        e, made = self.embed.shape[1], {}
        for w, filters in self.filters.items():
            each = [(self.embed @ filters[k * e : (k + 1) * e]).astype(np.float32) for k in range(w)]
            made[w] = [(each[k][:, None] + each[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)] + ([each[-1]] if w % 2 else [])
        return made

    def pooled(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        n, length = windows.shape
        pairs = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        out = []
        for w, parts in tables.items():
            span = length - w + 1
            total = None
            for k, table in enumerate(parts):
                codes = (pairs if len(table) == 65536 else windows)[:, 2 * k : 2 * k + span]
                found = table.take(codes.ravel(), axis=0)
                total = found if total is None else np.add(total, found, out=total)
            out.append(np.maximum(total.reshape(n, span, -1).max(axis=1) + self.bias[w], 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]] | None = None) -> np.ndarray:
        z = self.pooled(windows, tables or self.tables()).astype(np.float64) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], widths=(2, 3, 4), filters: int = 8, embed: int = 8, passes: int = 6, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy of a softmax over max-pooled filters."""
    rng = np.random.default_rng(seed)
    classes, f = len(languages), filters
    p = {"E": rng.normal(0, 0.5, (256, embed)), "O": rng.normal(0, 0.3, (len(widths) * f, classes)), "o": np.zeros(classes)}
    for w in widths:
        p[f"W{w}"], p[f"b{w}"] = rng.normal(0, (w * embed) ** -0.5, (w * embed, f)), np.zeros(f)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            x, y = windows[order[at : at + 64]], labels[order[at : at + 64]]
            n, rows = len(x), np.arange(len(x))
            emb = p["E"][x]
            pooled, picks = [], {}
            for w in widths:
                span = x.shape[1] - w + 1
                stacked = np.concatenate([emb[:, k : k + span] for k in range(w)], axis=2)
                z = stacked @ p[f"W{w}"]
                pick = z.argmax(axis=1)
                top = np.take_along_axis(z, pick[:, None], 1)[:, 0] + p[f"b{w}"]
                picks[w] = (stacked, pick, top > 0)
                pooled.append(np.maximum(top, 0))
            h = np.concatenate(pooled, axis=1)
            z = h @ p["O"] + p["o"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[rows, y] -= 1
            q /= n
            g = {"O": h.T @ q, "o": q.sum(0), "E": np.zeros_like(p["E"])}
            back = q @ p["O"].T
            for i, w in enumerate(widths):
                stacked, pick, on = picks[w]
                d = back[:, i * f : (i + 1) * f] * on
                used = stacked[rows[:, None], pick]
                g[f"W{w}"], g[f"b{w}"] = np.einsum("nfe,nf->ef", used, d), d.sum(0)
                toward = d[:, :, None] * p[f"W{w}"].T[None]
                for k in range(w):
                    np.add.at(g["E"], x[rows[:, None], pick + k], toward[:, :, k * embed : (k + 1) * embed])
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return ByteNet(languages, p["E"], {w: p[f"W{w}"] for w in widths}, {w: p[f"b{w}"] for w in widths}, p["O"].astype(np.float64), p["o"].astype(np.float64))


def windows_of(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover the texts whole (the last of each filled with bytes 0), the text of each, and its bytes."""
    counts = np.array([-(-len(x) // length) for x in texts], np.int64)
    data = np.frombuffer(b"".join(x.ljust(c * length, b"\0") for x, c in zip(texts, counts.tolist(), strict=True)), np.uint8)
    of = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(of), length)
    some = np.flatnonzero(counts)
    sizes[np.cumsum(counts)[some] - 1] = [len(texts[i]) - (counts[i] - 1) * length for i in some]
    return data.reshape(-1, length), of, sizes


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = 4000, seed: int = 1) -> ByteNet | None:
    """A network fitted on one window from each of at most `rows` labelled rows, those first in the order of a hash of
    their text and label. Null texts or labels teach nothing; without labelled rows there is no network."""
    picked = labelled.filter(F.col(text).isNotNull() & (F.length(text) > 0) & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text, F.lit(seed)).alias("h"), F.col(text).alias("text"))
    window = F.substring("text", (F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.length("text") - WINDOW))).cast("int"), F.lit(WINDOW))
    found = hash_sample(picked.select("lang", "h", window.alias("w")), ["h", "lang"], rows)[0].collect()
    if not found:
        return None
    languages = sorted({r.lang for r in found})
    data = np.zeros((len(found), WINDOW), np.uint8)
    for i, r in enumerate(found):
        b = r.w.encode()[:WINDOW]
        data[i, : len(b)] = np.frombuffer(b, np.uint8)
    return train(data, np.array([languages.index(r.lang) for r in found]), languages)


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", batch: int = 2048) -> DataFrame:
    """docs with lang_pred and score: the language of the largest mean log-probability over all windows of the whole
    text, weighted by their bytes, and its share of the softmax of those means.

    `und` and score 0 if the text is null or has no letter, or if nothing was learned. Columns with these names are
    replaced; all others pass.
    """
    picked = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        from .words import blocks

        letter, net = regex.compile(r"\p{L}"), sent.value
        tables = net.tables() if net else None
        for part, texts in blocks(batches, text):
            has = [bool(net) and letter.search(x.decode("utf-8", "replace")) is not None for x in texts]
            said, scores = ["und"] * len(texts), [0.0] * len(texts)
            if any(has):
                data, of, sizes = windows_of(texts)
                logs = np.concatenate([net.log_probabilities(data[i : i + batch], tables) for i in range(0, len(data), batch)])
                total = np.zeros((len(texts), len(net.languages)))
                np.add.at(total, of, logs * sizes[:, None])
                weight = np.bincount(of, sizes, len(texts))
                for i in np.flatnonzero(has):
                    mean = total[i] / weight[i]
                    share = np.exp(mean - mean.max())
                    best = int(mean.argmax())
                    said[i], scores[i] = net.languages[best], float(share[best] / share.sum())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema), "lang_pred string, score double"])
    return picked.mapInArrow(run, schema)


def held_out(doc_id: str | Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part
