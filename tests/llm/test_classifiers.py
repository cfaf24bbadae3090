"""Language and toxicity on held-out rows."""

from pyspark.sql import functions as F

from textloom.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", langid.held_out("doc_id", 5, 0))
    net = langid.fit(docs.filter("not held"))
    got = langid.identify(docs.filter("held").withColumn("score", F.lit("clash")), net).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odds = {r.doc_id: r for r in langid.identify(odd, net).collect()}
    assert all(odds[i].lang_pred == "und" for i in (None, 1, 2, 3, 8)) and odds[4].lang_pred in net.languages
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_network_covers_long_texts_in_windows():
    data, of, sizes = langid.windows_of([b"", b"a" * 256, b"b" * 257, b"c"])
    assert data.shape == (4, 256) and of.tolist() == [1, 2, 2, 3] and sizes.tolist() == [256, 256, 1, 1]
    assert data[2].tobytes() == b"b" + b"\0" * 255


def test_toxicity_on_held_out_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("held", langid.held_out("doc_id", 4, 2))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    both = docs.join(labels, "doc_id")
    machine = toxicity.fit(both.filter("not held"))
    got = toxicity.score(both.filter("held"), machine).select("toxic", "predicted", "score").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in got)
    assert hit >= 0.8 * sum(r.toxic for r in got) and hit >= 0.8 * sum(r.predicted for r in got)
    texts = ["you are an id.iot", "you are an idi-ot", "such a stuupid plan", "the and of"]
    margins = [r.margin for r in toxicity.worst(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1), machine, "text").collect()]
    assert min(margins[:3]) > margins[3]
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, machine).collect())
    assert {r.score for r in toxicity.score(odd, toxicity.fit(both.limit(0))).collect()} == {0.0}


def test_kernel_is_the_sum_over_subsequences():
    import itertools

    def plain(a, b):
        total = 0.0
        for p in itertools.combinations(range(len(a)), 3):
            for q in itertools.combinations(range(len(b)), 3):
                if [a[i] for i in p] == [b[i] for i in q]:
                    total += toxicity.DECAY ** (p[2] - p[0] + q[2] - q[0] - 4)
        return total

    words = ["stupid", "st.upid", "banana", "abc"]
    x = toxicity.explicit(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(x[i] @ x[j] - plain(a, b) / (plain(a, a) * plain(b, b)) ** 0.5) < 1e-5


def plain_vector(word):
    """The word's unit vector in the operator's kernel space, subsequence by subsequence."""
    import itertools

    vector = {}
    for p in itertools.combinations(range(len(word)), toxicity.LETTERS):
        if p[-1] - p[0] < toxicity.SPAN:
            key = tuple(toxicity.codes([word[i] for i in p]).ravel().tolist())
            vector[key] = vector.get(key, 0) + toxicity.DECAY ** (p[-1] - p[0] - toxicity.LETTERS + 1)
    norm = sum(v * v for v in vector.values()) ** 0.5
    return {k: v / norm for k, v in vector.items()}


def test_margins_equal_plain_sums(spark):
    bad = ["you are a total idiot today", "what an idiotic thing he said", "such idiots everywhere here"]
    good = ["the idea of it was fine", "an ideal plan for the day", "we said good things about it", "nothing here to see at all"]
    labelled = spark.createDataFrame([(x, 1) for x in bad] * 2 + [(x, 0) for x in good] + [(None, 1), ("x", None)], "text string, toxic int")
    machine = toxicity.fit(labelled)
    table = dict(zip(machine.subsequences.tolist(), machine.weights.tolist(), strict=True))

    def plain(unit):
        ends = [unit] if len(unit) <= 20 else [f" {unit} "[a : a + 22] for a in range(0, len(unit) - 10, 10)]
        values = []
        for x in ends:
            x = x if len(unit) > 20 else f" {x} "
            vector = plain_vector(x) if len(x) >= toxicity.LETTERS else {}
            values.append(sum(table.get(sum(c * 32 ** (4 - i) for i, c in enumerate(k)), 0.0) * v for k, v in vector.items()))
        return max(values)

    texts = [*bad, *good, "", None, "idiot", "IDIOT!", "id.iot idi-ot i d i o t", "of to", "a" * 70 + "idiot" + "b" * 30, "éèê ñandú 你好世界你好 idíot"]
    docs = spark.createDataFrame([(x, 5.0) for x in texts], "text string, score double")
    got = toxicity.worst(docs.select("text").coalesce(1), machine, "text").collect()
    for r in got:
        want = sum(sorted((plain(u) for u in set(toxicity.units(r.text or ""))), reverse=True)[: toxicity.WORST])
        assert abs(want - r.margin) < 2e-3 * max(1, abs(want)), r.text
    scored = toxicity.score(docs, machine, threshold=0.3).collect()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in scored) and len(scored) == len(texts)
    assert toxicity.score(docs.limit(0), machine).count() == 0 and {r.predicted for r in scored if r.text in bad} == {1}


def test_network_equals_plain_convolution(spark, odd):
    """Scores from loops over windows, widths, places and filters."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    net = langid.ByteNet(["aa", "bb", "cc"], rng.normal(size=(256, 4)).astype(np.float32), {w: rng.normal(size=(w * 4, 3)).astype(np.float32) for w in (2, 3, 4)}, {w: rng.normal(size=3).astype(np.float32) for w in (2, 3, 4)}, rng.normal(size=(9, 3)), rng.normal(size=3))

    def plain(window):
        pooled = []
        for w in (2, 3, 4):
            for f in range(3):
                best = max(sum(float(net.embed[window[i + k]] @ net.filters[w][4 * k : 4 * k + 4, f]) for k in range(w)) for i in range(len(window) - w + 1))
                pooled.append(max(0.0, best + float(net.bias[w][f])))
        z = [sum(p * net.out[i, c] for i, p in enumerate(pooled)) + net.out_bias[c] for c in range(3)]
        total = math.log(sum(math.exp(x) for x in z))
        return [x - total for x in z]

    texts = ["short text", "long " * 90, "é" * 200, "x" * 256, "", None, "123 456"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id int, text string, lang_pred int")
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    for i, x in enumerate(texts):
        data = (x or "").encode()
        if not any(c.isalpha() for c in x or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        parts = [data[k : k + 256] for k in range(0, len(data), 256)]
        mean = sum(len(p) * np.array(plain(p.ljust(256, b"\0"))) for p in parts) / len(data)
        share = np.exp(mean) / np.exp(mean).sum()
        assert got[i].lang_pred == net.languages[int(share.argmax())] and abs(got[i].score - share.max()) < 1e-4
    assert langid.identify(docs.limit(0), net).count() == 0


def test_toxicity_keeps_other_columns(spark, odd):
    machine = toxicity.fit(spark.createDataFrame([("you idiot person", 1), ("a kind person here", 0)], "text string, toxic int"))
    rows = odd.withColumn("margin", F.lit("clash")).withColumn("predicted", F.lit("clash")).withColumn("toxic", F.lit(7))
    got = toxicity.score(rows, machine).collect()
    assert len(got) == odd.count() and {r.toxic for r in got} == {7} and {r.predicted for r in got} <= {0, 1}
