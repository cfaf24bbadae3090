"""Postings of a shard of chunks and the best of them for some questions, as a task of the index or of the scan sees them.

A row is a term's list in one shard: chunks by their number in the order of ids, counts, and maxima of blocks of BLOCK chunks.
The row of the term ALL, which no word is, has the lengths of all chunks of the shard instead.
"""

from __future__ import annotations

#: Documents that share a block maximum.
BLOCK = 128
ALL = ""
#: Lists are packed as 16-bit numbers, or as 32-bit ones where a shard is `wide`.
LISTS = "docs binary, tfs binary, blocks binary, max_tf binary, min_len binary"
POSTINGS = f"term string, n int, shard int, wide boolean, {LISTS}"


def inverted(t, shard: int):
    """The postings of one shard, whose chunks have the terms t, a list array in the order of ids; and their lengths."""
    import numpy as np
    import pyarrow as pa

    sizes = np.diff(t.offsets.to_numpy()).astype(np.int64)
    doc = np.arange(len(sizes), dtype=np.int64)
    coded = t.flatten().dictionary_encode()
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | np.repeat(doc, sizes), return_counts=True)
    term, of = pair >> 32, pair & 0xFFFFFFFF
    first_of = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    starts, firsts = first_of(term), first_of(term << 32 | of // BLOCK)
    by_term = np.searchsorted(firsts, starts)
    most, least = (np.maximum.reduceat(tf, firsts), np.minimum.reduceat(sizes[of], firsts)) if len(pair) else (tf, sizes[of])
    wide = bool(len(sizes) > 65536 or sizes.max(initial=0) > 65535)
    kind, width = ("<i4", 4) if wide else ("<u2", 2)

    def lists(values, at, whole=b""):
        ends = width * np.append(at, len(values))
        return pa.Array.from_buffers(pa.binary(), len(at) + 1, [None, pa.py_buffer(np.append(ends, ends[-1] + len(whole)).astype(np.int32)), pa.py_buffer(values.astype(kind).tobytes() + whole)])

    m = len(starts) + 1
    return pa.table({
        "term": pa.concat_arrays([coded.dictionary.take(pa.array(term[starts])).cast(pa.string()), pa.array([ALL])]),
        "n": pa.array(np.append(np.diff(np.append(starts, len(pair))), len(sizes)).astype(np.int32)), "shard": pa.array(np.full(m, shard, np.int32)), "wide": pa.array([wide] * m),
        "docs": lists(of, starts, sizes.astype(kind).tobytes()), "tfs": lists(tf, starts),
        "blocks": lists(of[firsts] // BLOCK, by_term), "max_tf": lists(most, by_term), "min_len": lists(least, by_term),
    }), sizes


def best(table, k: int, k1: float, b: float, mean_len: float):
    """(questions, chunk numbers, scores): the k best chunks of a shard for each of some questions, from the rows of all their
    terms with `asked`, an array of query_id and weight.

    A block's bound is the sum of its terms' largest parts. The blocks with the highest bounds are scored first; of the others
    only those whose bound reaches the k-th score so far.
    """
    import numpy as np

    table = table.combine_chunks()
    terms, kind = table["term"].to_pylist(), "<i4" if table["wide"][0].as_py() else "<u2"
    lists = {c: [np.frombuffer(x, kind).astype(np.int64) for x in table[c].to_pylist()] for c in ("docs", "tfs", "blocks", "max_tf", "min_len")}
    size = lists["docs"][terms.index(ALL)]
    n = len(size)
    part = lambda tf, long: tf * (k1 + 1) / (tf + k1 * (1 - b + b * long / mean_len))
    asked: dict[object, list[tuple[int, float]]] = {}
    for i, questions in enumerate(table["asked"].to_pylist()):
        for q in questions if terms[i] != ALL else []:
            asked.setdefault(q["query_id"], []).append((i, q["weight"]))
    parts = [part(tfs, size[docs]) if t != ALL else None for t, docs, tfs in zip(terms, lists["docs"], lists["tfs"])]
    bounds = [part(m, x) for m, x in zip(lists["max_tf"], lists["min_len"])]
    out_q, out_d, out_s = [], [], []
    for question, of in asked.items():
        bound, held = np.zeros(-(-n // BLOCK)), np.zeros(-(-n // BLOCK), bool)
        for i, w in of:
            bound[lists["blocks"][i]] += np.maximum(w * bounds[i], 0)
            held[lists["blocks"][i]] = True
        first = np.argsort(-np.where(held, bound, -np.inf), kind="stable")[: max(1, -(-2 * k // BLOCK))]
        score, met, open_ = np.zeros(n), np.zeros(n, bool), np.zeros(len(bound), bool)
        open_[first] = True

        def add(which):
            for i, w in of:
                docs = lists["docs"][i]
                some = which[docs // BLOCK]
                score[docs[some]] += w * parts[i][some]
                met[docs[some]] = True

        add(open_)
        got = np.sort(score[met])
        # A little below the k-th score, as sums and rounding may differ in the last places.
        least = got[-k] - 1e-5 if len(got) >= k else -np.inf
        add(held & ~open_ & (bound >= least))
        docs = np.flatnonzero(met)
        s = np.round(score[docs], 6)
        top = np.lexsort((docs, -s))[:k]
        out_q += [question] * len(top)
        out_d.append(docs[top])
        out_s.append(s[top])
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return out_q, cat(out_d, np.int32), cat(out_s, np.float64)
