"""Toxicity by a support vector machine over a gap-tolerant subsequence kernel with Nyström landmarks.

The kernel of two words sums, over all subsequences of LETTERS letters that span SPAN places at most, the products of
their weights; a weight falls by DECAY for each place skipped, so letters put between those of an insult cost little. The
kernel of two sentences sums over their words. Landmarks, words of the labelled texts, map a sentence to
K(sentence, landmarks) K(landmarks, landmarks)^-1/2, where a linear machine is trained on labelled sentences. Its
decision is linear in the subsequence weights, so it folds into one number for each subsequence that a landmark has,
and a task scores a distinct word once. A text's margin is that of its WORST worst words taken as a sentence, and is
mapped to a probability fitted on the labelled texts.
"""

from __future__ import annotations

import heapq
import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_sample

DECAY, LETTERS, SPAN, ALPHABET, WORST = 0.6, 5, 7, 32, 3
#: Letters of a unit that are scored at a time; longer units are scored in overlapping parts.
LONGEST = 20
#: Words of a sentence; longer sentences are taken in parts.
SENTENCE = 24
#: Characters of texts whose new units are scored together.
BLOCK = 1 << 20
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?!\S)")
_END = re.compile(r"[.!?]*\s*\n|[.!?]+\s")
_places: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
_folded: dict[str, int] = {}


def places(n: int, letters: int, span: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of n letters, as an array of places for each of their letters, and their weights."""
    key = n, letters, span
    if key not in _places:
        reach = min(n, span or n) - 1
        rest = np.array(list(itertools.combinations(range(1, reach + 1), letters - 1)), np.int64).reshape(-1, letters - 1)
        each = [np.hstack([np.full((len(rest), 1), i), rest + i]) for i in range(n)]
        at = np.concatenate(each) if each else np.zeros((0, letters), np.int64)
        at = at[at[:, -1] < n]
        _places[key] = at.T.copy(), (DECAY ** (at[:, -1] - at[:, 0] - letters + 1)).astype(np.float32)
    return _places[key]


def codes(words: list[str]) -> np.ndarray:
    """Letters a to z as 0..25, other letters as one of 27..31, anything else as 26."""
    out = []
    for c in "".join(words):
        if c not in _folded:
            _folded[c] = ord(c) - 97 if "a" <= c <= "z" else 27 + ord(c) % 5 if c.isalpha() else 26
        out.append(_folded[c])
    return np.array(out, np.int32).reshape(len(words), -1)


def features(words: list[str], letters: int = 3, span: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words of each length: their indices, subsequence codes, weights, and norms in the kernel's space."""
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    for n, every in by.items():
        at, weight = places(n, letters, span)
        if not len(weight):
            continue
        step = max(1, 400_000 // len(weight))
        for part in (every[a : a + step] for a in range(0, len(every), step)):
            own = codes([words[x] for x in part])
            code = own[:, at[0]]
            for k in at[1:]:
                code = code * ALPHABET + own[:, k]
            order = np.argsort(code, axis=1, kind="stable")
            flat = np.take_along_axis(code, order, 1) + np.arange(len(part))[:, None] * ALPHABET**letters
            sums = np.add.reduceat(weight[order].ravel(), first := np.flatnonzero(np.diff(flat.ravel(), prepend=-1)))
            norm = np.sqrt(np.bincount(flat.ravel()[first] // ALPHABET**letters, sums * sums, len(part)))
            yield np.array(part), code, weight, norm


def explicit(words: list[str], letters: int = 3, span: int | None = None) -> np.ndarray:
    """Unit vectors of the words in the kernel's space."""
    out = np.zeros((len(words), ALPHABET**letters), np.float32)
    for part, code, weight, norm in features(words, letters, span):
        np.add.at(out, (part[:, None], code), weight[None])
        out[part] /= norm[:, None]
    return out


def parts(unit: str) -> list[str]:
    """A unit between marks of its ends, in overlapping parts if it is long."""
    if len(unit) <= LONGEST:
        return [f" {unit} "]
    ends = range(0, len(unit) - LONGEST // 2, LONGEST // 2)
    return [f" {unit} "[a : a + LONGEST + 2] for a in ends]


@dataclass
class Machine:
    """What each subsequence adds to a decision (others: nothing), and the logistic map from margins to probabilities."""

    subsequences: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    kept: dict[str, float] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"kept": {}, "table": None}

    def margins(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(ALPHABET**LETTERS, np.float16)
            self.table[self.subsequences] = self.weights
        out = np.zeros(len(words))
        for part, code, weight, norm in features(words, LETTERS, SPAN):
            out[part] = self.table.take(code) @ weight / norm
        return out

    def learn(self, units: set[str], limit: int = 300_000) -> dict[str, float]:
        new = list(units.difference(self.kept))
        if new:
            if len(self.kept) + len(new) > limit:
                self.kept, new = {}, list(units)
            split = [parts(u) for u in new]
            flat = list(dict.fromkeys(x for p in split for x in p))
            value = dict(zip(flat, self.margins(flat).tolist(), strict=True))
            self.kept.update((u, max(value[x] for x in p)) for u, p in zip(new, split, strict=True))
        return self.kept

    def margin(self, found: set[str], known: dict[str, float]) -> float:
        """Of the worst units as a sentence."""
        return sum(heapq.nlargest(WORST, map(known.__getitem__, found)))


def units(text: str) -> list[str]:
    """The words in lower case without outer punctuation, and letters spelled apart as one word."""
    low = text.lower()
    out = [w.strip(string.punctuation) for w in low.split()]
    out += [re.sub(r"[ .*_-]", "", m) for m in _SPACED.findall(low)]
    return out


def sentences(text: str) -> list[list[str]]:
    """The distinct parts of the units of each sentence of a text."""
    out = []
    for x in _END.split(text):
        own = list(dict.fromkeys(p for u in units(x) if len(u) > 2 for p in parts(u)))
        out += [own[k : k + SENTENCE] for k in range(0, len(own), SENTENCE)]
    return out


class Sample:
    """Labelled sentences as counts of their words, and the words as weighted subsequences."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        each = [(i, s) for i, x in enumerate(texts) for s in sentences(x)]
        self.text = np.array([i for i, _ in each], np.int64)
        vocabulary: dict[str, int] = {}
        self.word = np.array([vocabulary.setdefault(w, len(vocabulary)) for _, s in each for w in s], np.int32)
        self.sentence = np.repeat(np.arange(len(each), dtype=np.int32), [len(s) for _, s in each])
        self.words = list(vocabulary)
        self.label = np.where(toxic[self.text], 1.0, -1.0)
        rows, columns, values, codes_of = [], [], [], np.zeros(0, np.int32)
        for part, code, weight, norm in features(self.words, LETTERS, SPAN):
            rows.append(np.repeat(part, len(weight)).astype(np.int32))
            columns.append(code.ravel().astype(np.int32))
            values.append((weight[None] / norm[:, None]).ravel().astype(np.float32))
            codes_of = np.union1d(codes_of, columns[-1])
        self.row = np.concatenate([np.zeros(0, np.int32), *rows])
        self.value = np.concatenate([np.zeros(0, np.float32), *values])
        del rows, values
        self.codes = codes_of
        # Part by part, so that no index of all is made at once.
        self.column = np.concatenate([np.zeros(0, np.int32), *[np.searchsorted(codes_of, x).astype(np.int32) for x in columns]])

    def dense(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of some words, and the columns that any of them has."""
        place = np.full(len(self.words), -1)
        place[words] = np.arange(len(words))
        on = place[self.row] >= 0
        columns, inverse = np.unique(self.column[on], return_inverse=True)
        out = np.zeros((len(words), len(columns)), np.float32)
        np.add.at(out, (place[self.row[on]], inverse), self.value[on])
        return out, columns

    def of_marks(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The entries of some words' vectors by column: the word's place, the column's, the value; and the columns."""
        place = np.full(len(self.words), -1, np.int32)
        place[words] = np.arange(len(words))
        on = np.flatnonzero(place[self.row] >= 0)
        on = on[np.argsort(self.column[on], kind="stable")]
        columns, at = np.unique(self.column[on], return_inverse=True)
        return place[self.row[on]], at, self.value[on], columns

    def of_words(self, w: np.ndarray) -> np.ndarray:
        """The inner product of each word with w."""
        return np.bincount(self.row, self.value * w[self.column], len(self.words))

    def of_sentences(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence, self.of_words(w)[self.word], len(self.text))

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the sentences' vectors, each times its weight."""
        of_word = np.bincount(self.word, weights[self.sentence], len(self.words))
        return np.bincount(self.column, self.value * of_word[self.row], len(self.codes))


def pursue(sample: Sample, mean: np.ndarray, among: np.ndarray, number: int, each: int = 32) -> np.ndarray:
    """Words, of those among, picked `each` at a time by their inner product with what the words picked before leave of
    the mean; words of one step that are alike (cosine over one half) count once."""
    picked, rest = np.zeros(0, np.int64), mean
    allowed = among.copy()
    while len(picked) < number and allowed.any():
        witness = np.where(allowed, sample.of_words(rest), -np.inf)
        first = np.argsort(-witness, kind="stable")[: min(8 * each, int(allowed.sum()))]
        near, _ = sample.dense(first)
        alike, chosen = near @ near.T > 0.5, []
        for i in range(len(first)):
            if len(chosen) < min(each, number - len(picked)) and not alike[i, chosen].any():
                chosen.append(i)
        picked = np.concatenate([picked, first[chosen]])
        allowed[picked] = False
        m, columns = sample.dense(picked)
        gram = (m @ m.T).astype(np.float64)
        rest = mean.copy()
        rest[columns] -= m.T @ np.linalg.solve(gram + 1e-3 * np.eye(len(gram)), m @ mean[columns])
    return picked


def train(sample: Sample, landmarks: int = 1024, cost: float = 100.0, steps: int = 12) -> Machine:
    """A linear machine on Nyström features of the sentences, with squared hinge loss, by Newton steps.

    Each class counts the same, each toxic text the same, and each sentence of a toxic text the same. Half of the landmarks
    are words of toxic texts that span most of the difference of the classes' mean embeddings; the others are any words
    of clean texts.
    """
    y = sample.label
    of_text = np.bincount(sample.text, minlength=sample.text.max() + 1)
    share = np.where(y > 0, 1 / of_text[sample.text], 1.0)
    share = share / np.where(y > 0, share[y > 0].sum(), share[y < 0].sum())
    told = share * y
    toxic = np.bincount(sample.word, told[sample.sentence] > 0, len(sample.words)) > 0
    clean = np.flatnonzero(np.bincount(sample.word, told[sample.sentence] < 0, len(sample.words)) > 0)
    some = np.random.default_rng(0).permutation(clean)[: landmarks // 2]
    marks = np.union1d(pursue(sample, sample.mixed(told), toxic, landmarks // 2), some)
    of, at, value, columns = sample.of_marks(marks)
    gram = np.zeros((len(marks), len(marks)))
    for a in range(0, len(columns), 8192):
        lo, hi = np.searchsorted(at, [a, a + 8192])
        part = np.zeros((len(marks), 8192), np.float32)
        np.add.at(part, (of[lo:hi], at[lo:hi] - a), value[lo:hi])
        gram += part @ part.T
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-3 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])

    def folded(z: np.ndarray) -> np.ndarray:
        w = np.zeros(len(sample.codes))
        w[columns] = np.bincount(at, value * (root @ z)[of], len(columns))
        return w

    def gradient(weights: np.ndarray) -> np.ndarray:
        return root.T @ np.bincount(of, value * sample.mixed(weights)[columns][at], len(marks))

    z, offset, share = np.zeros(root.shape[1]), 0.0, share * cost
    for _ in range(steps):
        f = sample.of_sentences(folded(z)) + offset
        active = share * (y * f < 1)
        slope = -active * y * (1 - y * f)
        r, r0 = -(z + gradient(slope)), -slope.sum()
        d, d0, p, p0 = np.zeros_like(z), 0.0, r.copy(), r0
        size = first = r @ r + r0 * r0
        for _ in range(15):  # conjugate gradients for the Newton step
            curve = active * (sample.of_sentences(folded(p)) + p0)
            hp, h0 = p + gradient(curve), curve.sum() + 1e-6 * p0
            a = size / (p @ hp + p0 * h0)
            d, d0, r, r0 = d + a * p, d0 + a * p0, r - a * hp, r0 - a * h0
            size, old = r @ r + r0 * r0, size
            if size < 1e-4 * first:
                break
            p, p0 = r + size / old * p, r0 + size / old * p0
        z, offset = z + d, offset + d0
        if np.abs(d).max() < 1e-3:
            break
    return Machine(sample.codes[columns].astype(np.int64), folded(z)[columns].astype(np.float32))


def worst(docs: DataFrame, machine: Machine, text: str) -> DataFrame:
    """docs with margin: that of the worst units of the whole text; 0 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = sent.value
        for batch in batches:
            out, block, size = [], [], 0
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for at, x in enumerate(texts, 1):
                block.append(set(units(x or "")))
                size += len(x or "")
                if size >= BLOCK or at == len(texts):
                    known = machine.learn(set().union(*block))
                    out += [machine.margin(found, known) for found in block]
                    block, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "margin"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "margin double"])
    return docs.mapInArrow(run, schema)


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", rows: int = 2000, ratio: float | None = None) -> Machine | None:
    """A machine trained on the sentences of at most `rows` labelled rows, half of them toxic if there are as many: of each
    class the first in the order of a hash of the text. `ratio`: of toxic rows among all that scores are for; if not
    given, that of the labelled rows.

    A sentence has its text's label, and equal texts with equal labels count once. Words of one or two letters teach
    nothing, nor do rows without a text or a label; without both classes there is no machine.
    """
    known = labelled.filter(F.col(text).isNotNull() & F.col(toxic).isNotNull()).select(F.col(text).alias("text"), (F.col(toxic).cast("int") == 1).alias("toxic"))
    texts, label, number = [], [], []
    for kind in (True, False):
        own, n = hash_sample(known.filter(F.col("toxic") == kind), ["text"], rows // 2)
        found = sorted({r.text for r in own.collect()})
        texts, label, number = texts + found, label + [kind] * len(found), number + [n]
    y = np.array(label, float)
    ratio = number[0] / max(1, sum(number)) if ratio is None else ratio
    weight = np.where(y > 0, ratio / max(1, y.sum()), (1 - ratio) / max(1, (1 - y).sum())) * len(y)
    sample = Sample(texts, y == 1)
    if len(set(sample.label.tolist())) < 2:
        return None
    machine = train(sample)
    split = [set(units(x)) for x in texts]
    known = machine.learn(set().union(*split), limit=1 << 62)
    m = np.array([machine.margin(s, known) for s in split])
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([(weight * (p - y) * m).sum() + 0.01 * a, (weight * (p - y)).sum()])
        h = weight * (p * (1 - p) + 1e-9)
        hess = np.array([[(h * m * m).sum() + 0.01, (h * m).sum()], [(h * m).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        step *= min(1, 5 / np.abs(step).max())
        a, b = a - step[0], b - step[1]
    machine.slope, machine.shift, machine.kept = float(max(a, 1e-3)), float(b), {}
    return machine


def score(docs: DataFrame, machine: Machine | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score, the probability that the whole text is toxic, and predicted, 1 from `threshold` on.

    Null and empty texts get the score of a text without words; without a machine every score is 0. Columns named
    margin, score or predicted are replaced.
    """
    picked = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("margin", "score", "predicted")])
    if machine is None:
        return picked.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    z = F.lit(machine.slope) * F.col("margin") + F.lit(machine.shift)
    out = worst(picked, machine, text).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).drop("margin")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
