"""The language model against a plain one, and its probabilities against one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import katz, langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Plain:
    def __init__(self, texts):
        self.uni, self.big, self.follow = Counter(), Counter(), defaultdict(set)
        self.first = Counter()
        for t in texts:
            self.uni.update(t)
            for a, b in zip([None, *t], t):
                self.big[a, b] += 1
                self.first[a] += 1
                self.follow[a].add(b)
        self.n = sum(self.uni.values())
        n_r = lambda c: [sum(1 for v in c.values() if v == r) for r in range(1, katz.LARGEST + 2)]
        self.d1, self.d2 = katz.discounts(n_r(self.uni)), katz.discounts(n_r(self.big))
        self.unknown = 1 - sum(self.cut(c, self.d1) for c in self.uni.values()) / self.n if self.n else 1.0

    def cut(self, c, d):
        return d[c] * c if c <= katz.LARGEST else c - katz.LEAST

    def p1(self, w):
        return self.cut(self.uni[w], self.d1) / self.n if self.uni[w] else self.unknown

    def p(self, w, h):
        if self.big[h, w]:
            return self.cut(self.big[h, w], self.d2) / self.first[h]
        if not self.first[h]:
            return self.p1(w)
        left = 1 - sum(self.cut(self.big[h, v], self.d2) for v in self.follow[h]) / self.first[h]
        return left / (1 - sum(self.p1(v) for v in self.follow[h])) * self.p1(w)


def test_scores_equal_a_plain_model(spark, odd, sample):
    docs = odd.filter("doc_id is not null").select("doc_id", "text").union(sample.select(F.col("doc_id") + 1000, "text").limit(60)).withColumn("score", F.lit("clash")).repartition(4)
    rows = [(r.doc_id, [*WORD.findall((r.text or "").translate(LOW)), "\n"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([t for i, t in rows if not held(i)])
    got = katz.score(docs, langid.held_out("doc_id", 7, 2)).collect()
    want = defaultdict(list)
    for i, t in rows:
        base = sum(math.log10((model.uni[w] + 1) / (model.n + len(model.uni) + 1)) for w in t)
        score = sum(math.log10(model.p(w, h)) for h, w in zip([None, *t], t))
        want[i].append((held(i), len(t), sum(model.uni[w] > 0 for w in t), model.n, base, score))
    assert len(got) == len(rows)
    for r in got:
        x = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert np.allclose([r.base_score, r.score], x[4:], rtol=1e-9)
    for h in [None, "the", "one", rows[5][1][0]]:
        total = sum(model.p(w, h) for w in model.uni) + model.p("never seen", h)
        assert abs(total - 1) < 1e-9
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_nothing_to_learn_from(spark, odd):
    assert katz.score(odd.limit(0), F.lit(False)).count() == 0
    got = katz.score(odd, F.lit(True)).collect()
    assert len(got) == odd.count() and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_packing_of_numbers():
    for values in ([], [0], [255, 1], [2**40, 3], [2**64 - 1, 0, 7]):
        a = np.array(values, np.uint64)
        assert katz.unpack(katz.pack(a)).tolist() == a.tolist()


def test_successors_of_a_frequent_word_are_dealt_over_buckets(spark):
    docs = spark.createDataFrame([(i, False, f"word{i}") for i in range(400)], "doc_id long, held_out boolean, text string")
    slices = katz.cut(katz._slices(docs))
    asked = katz._ask_pairs(slices, katz._count_words(katz._ask_words(slices, 8), 8), 8)
    sizes = [len(katz.unpack(r.c)) for r in asked.select("c").collect()]
    assert sum(sizes) == 800 and max(sizes) < 0.3 * sum(sizes)
    assert katz._buckets(16_000, 8) == 1000


def katz_discounts(n):
    """From the numbers of types seen 1 to 6 times: Good-Turing's r* / r, scaled so that the mass taken is that of n_1."""
    share, out = 6 * n[5] / n[0] if n[0] else 1.0, []
    for r in range(1, 6):
        most = 1 - 0.01 / r
        d = ((r + 1) * n[r] / n[r - 1] / r - share) / (1 - share) if n[r - 1] and share < 1 else most
        out.append(d if 0 < d < most else most)
    return out


def test_kept_tables_sum_to_one(spark, sample, tmp_path):
    """Another session opens the model's tables; they hold all counts, and all probabilities of each history sum to 1."""
    folder = str(tmp_path / "model")
    docs = sample.select("doc_id", "text").limit(80)
    rows = [[*WORD.findall((r.text or "").translate(LOW)), "\n"] for r in docs.collect()]
    got = katz.score(spark.createDataFrame([(i, " ".join(t[:-1])) for i, t in enumerate(rows)], "doc_id long, text string"), F.lit(False), tables=folder).collect()
    other = spark.newSession()
    words, grams = katz.open_words(other, folder).collect(), katz.open_bigrams(other, folder).collect()
    plain = Plain(rows)
    assert sorted(r.n for r in words) == sorted(plain.uni.values()) and sorted(r.n for r in grams) == sorted(plain.big.values())
    assert len({r.word for r in words}) == len({r.id for r in words}) == len(words) and got[0].train_tokens == plain.n
    count = lambda counts: [sum(c == r for c in counts) for r in range(1, 7)]
    for counts in ([r.n for r in words], [r.n for r in grams]):
        assert np.allclose(katz.discounts(count(counts))[1:], katz_discounts(count(counts)))
    model = katz.WordModel(plain.n, len(words), count([r.n for r in words]))
    p1 = dict(zip([r.id - 1 for r in words], model.probability(np.array([r.n for r in words])).tolist(), strict=True))
    assert abs(sum(p1.values()) + model.unknown - 1) < 1e-9
    d2 = katz.discounts(count([r.n for r in grams]))
    follow = defaultdict(list)
    for r in grams:
        follow[r.first].append((r.second, r.n))
    assert sorted(sum(n for _, n in own) for own in follow.values()) == sorted(plain.first.values())
    for own in follow.values():
        c = np.array([n for _, n in own])
        n_r = np.array([(np.minimum(c, 6) == r).sum() for r in range(1, 7)])
        seen = katz.discounted(c, d2).sum() / c.sum()
        back = katz.taken(n_r, d2) / c.sum() / (1 - sum(p1[w] for w, _ in own))
        assert abs(seen + back * (sum(p for w, p in p1.items() if w not in {w for w, _ in own}) + model.unknown) - 1) < 1e-9


def test_rows_without_ids_and_repeated_rows(spark, odd):
    got = katz.score(odd, langid.held_out("doc_id", 7, 2)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert len({(r.n_tokens, r.base_score, r.score) for r in got if r.doc_id == 6}) == 1


def test_two_letter_words_of_a_known_kind_stay_apart(spark):
    x = [["a", "b"][bin(i).count("1") % 2] for i in range(1024)]
    y = [["b", "a"][bin(i).count("1") % 2] for i in range(1024)]
    docs = spark.createDataFrame([(1, "".join(x) + " end"), (2, "".join(y) + " end"), (3, "".join(x) + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(docs, F.col("doc_id") == 2).collect()}
    assert (got[2].n_known, got[2].n_tokens, got[3].n_known) == (2, 3, 3)
