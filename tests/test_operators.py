"""Small fixtures for what SQL doesn't cover: windows, tables, pages, retrieval, graphs and healing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textloom import plans, sources
from textloom.operators import answers, caching, chunkers, graph, html, quality, retrieval, tables
from textloom.operators.windows import COUNTERS, WindowConfig, fitting, spans, windows


def test_window_config_is_checked():
    for bad in ({"size": 0}, {"size": 5, "overlap": 5}, {"overlap": -1}, {"min_size": 0}, {"scope": "page"}, {"counter": "none"}):
        with pytest.raises(ValueError):
            WindowConfig(**bad)


def test_closed_form_equals_the_walk(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(rng.randrange(60)))) for i in range(40)] + [(99, None), (98, "  ")], "doc_id int, text string")
    for size, overlap in ((10, 3), (7, 0), (1, 0), (60, 59)):
        c = WindowConfig(size=size, overlap=overlap, boundary=False)
        got = {(r.doc_id, r.window_index): r.window for r in windows(docs, "text", c).collect()}
        want = {(r.doc_id, k): " ".join((r.text or "").split()[a:b]) for r in docs.collect() for k, (a, b) in enumerate(spans((r.text or "").split(), c))}
        assert got == want


def test_boundaries_end_windows():
    words = "a b. c d e f. g h i j k".split()
    assert list(spans(words, WindowConfig(size=5, overlap=1, min_size=3))) == [(0, 2), (1, 6), (5, 6), (6, 11)]
    # the floor counts from the text's start unless asked otherwise, so words can go missing
    far = [*"a b.".split(), *("x " * 20).split()]
    lost = list(spans(far, WindowConfig(size=5, overlap=1, min_size=3)))
    assert any(b[0] > a[1] for a, b in zip(lost, lost[1:])) or lost[-1][1] == len(far)
    assert all(b > a for a, b in spans(far, WindowConfig(size=5, overlap=1, min_size=3, scope="window")))


def test_fitting_finds_the_last_end_that_is_not_over():
    for most in range(1, 30):
        for last in range(1, most + 1):
            for guess in range(0, 35):
                assert fitting(lambda e: e > last, 1, most, guess) == last
    assert fitting(lambda e: True, 4, 9, 7) == 4


def brute_spans(tokens, c, count):
    start, n, floor = 0, len(tokens), max(1, c.min_size // 3)
    while start < n:
        end = min(start + c.size, n)
        while end - start > 1 and count(" ".join(tokens[start:end])) > c.size:
            end -= 1
        if c.boundary and end < n:
            end = next((i for i in range(end, floor, -1) if tokens[i - 1][-1] in c.boundary_chars), end)
        if end > start:
            yield start, end
        if end >= n:
            return
        start = max(start + 1, end - max(1, c.overlap))


def test_windows_by_another_count(monkeypatch):
    """Equal to taking words off one by one, and few counts for each window, however long the text."""
    called = []
    count = lambda text: called.append(1) or sum(1 + len(w) // 3 for w in text.split())
    monkeypatch.setitem(COUNTERS, "thirds", count)
    rng = random.Random(3)
    made = lambda n: ["".join(rng.choice("abc.") for _ in range(rng.choice((1, 2, 5, 40)))) for _ in range(n)]
    for n in (0, 1, 7, 300):
        for boundary in (True, False):
            c, tokens = WindowConfig(size=30, overlap=5, min_size=9, boundary=boundary, counter="thirds"), made(n)
            assert list(spans(tokens, c)) == list(brute_spans(tokens, c, count))
    long, c = made(20_000), WindowConfig(size=100, overlap=10, boundary=False, counter="thirds")
    called.clear()
    found = list(spans(long, c))
    assert found[-1][1] == 20_000 and len(called) <= 12 * len(found)


def test_subword_windows_count_each_word_once(monkeypatch):
    """However many windows overlap: words of many windows, odd ones too, are encoded twice at most."""
    import public_tokenizers

    from textloom.operators import windows as module

    count = module.subword_counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    odd = ["it's", "'s", "<|endoftext|>", "a<|endoftext|>b", "x" * 90, "é\u0301\u200b", "\u4e16\u754c", "42%", "...", "\ufffd", "I'll", "1,000.5"]
    tokens = [rng.choice(odd + ["plain", "word"] * 6) for _ in range(600)]
    monkeypatch.setitem(COUNTERS, "bpe", count)
    c = WindowConfig(size=40, overlap=9, boundary=False, counter="bpe")
    want = list(brute_spans(tokens, c, count))
    called = []
    plain = type(count).__call__
    monkeypatch.setattr(type(count), "__call__", lambda self, text: called.append(text) or plain(self, text))
    assert list(spans(tokens, c)) == want
    assert len([x for x in called if len(x) <= 64]) <= 2 * len(odd + ["plain", "word"])
    assert not module.cuts_at_spaces('{"pre_tokenizer": {"type": "Metaspace"}, "model": {"type": "BPE"}}')


def test_windows_leave_a_task_in_bounded_parts(spark, monkeypatch):
    """A long text isn't repeated for its windows, and its windows don't leave as one batch."""
    from textloom.operators import windows as module

    monkeypatch.setattr(module, "TOGETHER", 1000)
    df = spark.createDataFrame([(1, "word. " * 2000), (2, None), (3, "one.")], "id int, text string").coalesce(1)
    rows = windows(df, "text", WindowConfig(size=20, overlap=2), source=False)
    assert rows.columns == ["id", "window_index", "window"]
    whole = windows(df, "text", WindowConfig(size=20, overlap=2))
    assert [r.window for r in rows.collect()] == [r.window for r in whole.collect()] and whole.columns[1] == "text"


def test_subword_chunks_equal_brute_force(spark):
    import hashlib

    from textloom.plans.queries import QUERIES

    got = {(r.doc_id, r.chunk_index): (r.n_words, r.digest) for r in QUERIES["chunk_subword"](spark, "/root/testdata/sf0.001").collect()}
    c, count = WindowConfig(size=200, overlap=20, counter="byte_bpe_50k"), COUNTERS["byte_bpe_50k"]
    short = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 3000]
    want = {}
    for r in short:
        tokens = (r.text or "").split()
        for k, (a, b) in enumerate(brute_spans(tokens, c, count)):
            want[r.doc_id, k] = (b - a, hashlib.md5(" ".join(tokens[a:b]).encode()).hexdigest())
    ids = {r.doc_id for r in short}
    assert len(ids) > 100 and {k: v for k, v in got.items() if k[0] in ids} == want


def test_headings_and_paragraphs(spark):
    text = "intro words\n# One\nbody one\n#### deep\nmore\n## Two\n"
    rows = chunkers.chunk_headings(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_index").collect()
    assert [(r.heading, r.level, r.text) for r in rows] == [(None, None, "intro words"), ("# One", 1, "# One body one #### deep more"), ("## Two", 2, "## Two")]
    p = [(1, 0, None, "start"), (1, 1, "Heading 2", "H"), (1, 2, "Normal", "x y"), (1, 3, "Normal", " "), (1, 4, "Title", "alone")]
    rows = chunkers.chunk_paragraphs(spark.createDataFrame(p, "doc_id int, pos int, style string, text string")).orderBy("chunk_index").collect()
    assert [(r.heading, r.level, r.text) for r in rows] == [(None, None, "start"), ("H", 2, "H x y")]


def test_pages_joined(spark):
    pages = spark.createDataFrame([(1, 2, "c d"), (1, 1, "a b"), (1, 3, " ")], "doc_id int, page int, text string")
    assert [r.text for r in chunkers.chunk_pages(pages, within_page=False).collect()] == ["a b c d"]
    assert [(r.page_number, r.text) for r in chunkers.chunk_pages(pages).orderBy("chunk_index").collect()] == [(1, "a b"), (2, "c d")]


def test_delimited_and_cells(spark):
    docs = spark.createDataFrame([(1, "name,age\nann, 5\nbob,nan"), (2, "x\ty\n1\t2")], "doc_id int, text string")
    got = [(r.doc_id, r.row, r.header, r.value) for r in chunkers.parse_delimited(docs).orderBy("doc_id", "row", "col").collect()]
    assert got == [(1, 0, "name", "ann"), (1, 0, "age", "5"), (1, 1, "name", "bob"), (1, 1, "age", "nan"), (2, 0, "x", "1"), (2, 0, "y", "2")]
    assert chunkers.parse_delimited(docs, 0).filter("header = 'Col1'").count() == 5
    sheet = spark.createDataFrame([(0, "ann", None), (1, "bob", "NaN"), (2, "cy", "7")], "row int, name string, age string")
    got = [r.text for r in chunkers.chunk_cells(sheet, ["name", "age"], "row", F.lit("s")).orderBy("chunk_index").collect()]
    assert got == ["name: ann", "name: bob", "name: cy", "age: 7"]


def test_images_and_captions(spark):
    regions = spark.createDataFrame([(1, 1, 0, 100, 100, "png"), (1, 1, 1, 10, 10, "png")], "doc_id int, page int, image_index int, width int, height int, ext string")
    rows = chunkers.chunk_images(regions)
    assert [r.text for r in rows.collect()] == ["[Image 0 on page 1: 100x100 png]"]
    said = chunkers.caption(rows, F.lit("a red cat")).collect()[0]
    assert (said.text, said.token_count, said.captioned) == ("a red cat", 3, True)
    assert chunkers.caption(rows).collect()[0].text.startswith("[Image")
    with pytest.raises(Exception, match="captioning failed"):
        chunkers.caption(rows, on_failure="raise").collect()


def test_stitching(spark):
    head, row = ["Name", "Score"], lambda k: [f"n{k}", str(k)]
    frames = [(1, 1, 0, [head, row(1), row(2)]), (1, 2, 0, [["name ", "SCORE"], ["NAME", "score"], row(3)]), (1, 4, 0, [head, row(4)]), (1, 5, 0, [head, row(5)]), (2, 1, 0, [["1", "2"], ["3", "4"]]), (2, 2, 0, [[None, " "], ["x", None]])]
    raw = spark.createDataFrame(frames, "doc_id int, page int, table_index int, cells array<array<string>>")
    split = tables.split_headers(raw)
    got = {(r.doc_id, r.table_no): r for r in tables.stitch(split).collect()}
    assert [(r.page_start, r.page_end, len(r.rows)) for r in (got[1, 0], got[1, 1])] == [(1, 2, 3), (4, 5, 2)]
    assert got[2, 0].headers == ["Col1", "Col2"] and got[2, 0].rows == [["1", "2"], ["3", "4"]]
    md = tables.table_chunks(tables.stitch(split)).filter("doc_id = 1 and chunk_index = 1").collect()[0]
    assert md.text == "| Name | Score |\n| ---- | ----- |\n| n4   | 4     |\n| n5   | 5     |" and md.stitched
    assert tables.table_chunks(tables.stitch(split), "csv").filter("doc_id = 1 and chunk_index = 1").collect()[0].text == "Name,Score\r\nn4,4\r\nn5,5"
    pipes = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\ntext"), (2, "no")], "doc_id int, text string")
    assert [r.cells for r in tables.parse_pipes(pipes).collect()] == [[["a", "b"], ["1", "2"]]]


def test_html_nodes(spark):
    page = "<div>out <p>in <b>bold</b></p><script>no()</script></div><p>two<br>lines</p>"
    assert html.page_nodes(page)[0] == [("p", "in bold"), ("p", "two lines"), ("div", "out in bold")]
    assert [t for t, _ in html.page_nodes(page, document_order=True)[0]] == ["div", "p", "p"]
    rows = html.chunk_html(spark.createDataFrame([(1, page), (2, "plain & text"), (3, None)], "doc_id int, html string")).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, "in bold two lines out in bold"), (2, "plain & text")]


def test_quality_scores(spark):
    texts = ["Page 12", "CONFIDENTIAL do not share", "...  !!", "aaaaaaa", "the cat the cat the cat the cat the cat", "good � text here.", "12 34 56 78 90 12 34 56 78 90 a", "", "lower start without end", "A fine sentence of ten words stands here for all."]
    got = {r.text: r for r in quality.score(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [got[t].information_score for t in texts[:5]] == [0.1, 0.1, 0.1, 0.1, 0.222]
    assert got[texts[5]].encoding_score == 0.2 and got[texts[6]].encoding_score < 0.3
    assert got[""].quality_score == 0.175 and got[""].quality_action == "excluded"
    assert got[texts[8]].boundary_score == 0.5 and got[texts[9]].quality_score == 1.0
    judged = quality.score(spark.createDataFrame([("Page 12",)], "text string"), judge=F.lit(2.0), mode="llm_always").collect()[0]
    assert judged.quality_score == round((got["Page 12"].quality_score + 1) / 2, 4)


def test_fusion_and_mmr(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    assert [r.chunk_id for r in retrieval.fuse(a, b).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.chunk_id for r in retrieval.fuse(a, b, alpha=1.0).orderBy("rank").collect()] == ["x", "y"]
    c = spark.createDataFrame([(1, "p", 0.9, [1.0, 0.0]), (1, "q", 0.89, [1.0, 0.01]), (1, "r", 0.5, [0.0, 1.0]), (1, "s", 0.1, [0.0, 0.0])], "query_id int, chunk_id string, score double, vector array<double>")
    assert [r.chunk_id for r in retrieval.mmr(c, 2).orderBy("rank").collect()] == ["p", "r"]
    assert [r.chunk_id for r in retrieval.mmr(c, 3, 1.0).orderBy("rank").collect()] == ["p", "q", "r"]
    with pytest.raises(ValueError):
        retrieval.fuse(a, b, alpha=2)


def test_bm25_fills_up_with_zero_scores(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["red cat", "blue dog", "green bird", "old red barn"])], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "red"), (2, "missing")], "query_id int, query string")
    got = retrieval.bm25(queries, chunks, 3, idf="lucene").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score > 0) for r in got] == [(1, 0, True), (1, 3, True), (1, 1, False), (2, 0, False), (2, 1, False), (2, 2, False)]


def test_healing(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    result = lambda rows: lambda q: spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int").join(q.select("query_id"), "query_id", "left_semi")
    ways = {"a": result([(1, "x", 0.9, 1), (2, "x", 0.1, 1)]), "b": result([(1, "never", 0.99, 1), (2, "y", 0.8, 1)]), "c": result([(3, "z", 0.2, 1)])}
    verdicts, kept = retrieval.heal(queries, ways, ["a", "b", "c"], "a")
    got = {r.query_id: (r.final_strategy, r.retries, r.action, r.passed) for r in verdicts.collect()}
    assert got == {1: ("a", 0, "none", True), 2: ("b", 1, "healed", True), 3: ("c", 2, "healed", False)}
    assert {(r.query_id, r.chunk_id) for r in kept.collect()} == {(1, "x"), (2, "y"), (3, "z")}
    assert {r.action for r in retrieval.heal(queries, ways, ["a"], "a")[0].filter("query_id > 1").collect()} == {"skipped"}


def test_components_after_each_batch(spark):
    """Ten batches of links, each merged into the labels of those before it: as from all links at once."""
    rng = random.Random(11)
    made = lambda links: spark.createDataFrame(links, "a int, b int")
    label, known, size = spark.createDataFrame([], "id int, component int"), [], []
    for _ in range(10):
        batch = [(rng.randrange(150), rng.randrange(150)) for _ in range(12)]
        batch = [x for x in batch if x[0] != x[1]]
        known += batch
        label = graph.extended(label, made(batch))
        got = {r.id: r.component for r in label.collect()}
        parent = {i: i for x in known for i in x}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in known:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        assert got == {i: root(i) for i in parent}
        size.append(len(got))
    assert {r.id: r.component for r in graph.connected(made(known)).collect()} == got
    assert {r.id: r.component for r in graph.extended(label, made([])).collect()} == got
    more = {r.id: r.component for r in graph.extended(label, made([(None, 1), (500, 500)])).collect()}
    assert more == got | {500: 500}


def test_graph(spark):
    ents = spark.createDataFrame([(n, n, "X") for n in "abcdez"], "id string, name string, entity_type string")
    edges = spark.createDataFrame([("a", "b", "R", 1, "c1"), ("b", "c", "R", 2, "c2"), ("c", "a", "R", 3, "c3"), ("a", "b", "S", 4, "c4"), ("d", "e", "R", 5, "c5"), ("a", "ghost", "R", 6, "c6")], "src string, dst string, relation_type string, seq int, chunk_id string")
    built = graph.build(ents, edges)
    assert sorted((r.src, r.dst, r.seq) for r in built.collect()) == [("a", "b", 4), ("b", "c", 2), ("c", "a", 3), ("d", "e", 5)]
    entry = graph.entry_nodes(spark.createDataFrame([(1, "is A-b here?"), (2, "nothing")], "query_id int, text string"), ents)
    assert sorted((r.query_id, r.id) for r in entry.collect()) == [(1, "a"), (1, "b")]
    start = spark.createDataFrame([(1, "a")], "query_id int, id string")
    assert sorted(r.chunk_id for r in graph.traverse(start, built, 0).collect()) == ["c3", "c4"]
    assert sorted(r.chunk_id for r in graph.traverse(start, built, 5).collect()) == ["c2", "c3", "c4"]
    groups = {r.id: r.community for r in graph.components(ents, built).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    dense = spark.createDataFrame([(1, f"k{i}", i) for i in range(1, 6)], "query_id int, chunk_id string, rank int")
    found = spark.createDataFrame([(1, "g", 0), (1, "k1", 0)], "query_id int, chunk_id string, hop int")
    assert [r.chunk_id for r in graph.retrieve(dense, found).orderBy("rank").collect()] == ["k1", "k2", "k3", "k4", "k5"]
    assert [r.chunk_id for r in graph.retrieve(dense, found, interleave=True).orderBy("rank").collect()] == ["k1", "g", "k2", "k3", "k4"]


def test_entry_nodes_with_names_of_many_words(spark):
    names = ["St. John's Hospital, New York", "St. John's Hospital, New York City", "New York", "a b c d e f", "a b c d e f g h i", "a b c d e f x"]
    ents = spark.createDataFrame([*enumerate(names), (9, None)], "id int, name string")
    texts = ["At ST. JOHN'S HOSPITAL, new york.", "St. John's Hospital, New Yorkshire", "of a b c d e f and of a b c d e f g h i.", "a b c d e f g h is", None]
    got = graph.entry_nodes(spark.createDataFrame([*enumerate(texts)], "query_id int, text string"), ents)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(0, 0), (0, 2), (2, 3), (2, 4), (3, 3)]


def test_communities_of_a_path_in_any_order(spark):
    ids = list(range(600))
    random.Random(5).shuffle(ids)
    ents = spark.createDataFrame([(i,) for i in [*ids, 900, 901, 902]], "id int")
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (900, 999), (999, 901)], "src int, dst int")
    assert {(r.id, r.community, r.size) for r in graph.components(ents, edges).collect()} == {(i, 0, 600) for i in ids}


def test_extraction_links(spark):
    reply = '{"entities": [{"name": "Ann", "entity_type": "person"}, {"name": "Bob"}], "relationships": [{"source": "Ann", "target": "Bob", "relation_type": "knows"}, {"source": "ann", "target": "Bob"}]}'
    parsed = graph.parse_extractions(spark.createDataFrame([(1, reply), (2, "oops"), (3, None)], "chunk_id int, reply string"))
    assert [(r.source, r.target, r.relation_type, r.weight, r.target_type) for r in graph.link_mentions(parsed).collect()] == [("Ann", "Bob", "KNOWS", 1.0, "CONCEPT")]


def test_grounding_and_context(spark):
    a = spark.createDataFrame([(1, "Paris stands beside water. Elephants invented calculus yesterday."), (2, " "), (3, "Short.")], "answer_id int, answer string")
    c = spark.createDataFrame([(1, "Paris is a city beside much water")], "answer_id int, text string")
    got = {r.answer_id: (r.grounded_claims, r.ungrounded_claims, r.score, r.action) for r in answers.groundedness(a, c).collect()}
    assert got == {1: (1, 1, 0.5, "flag"), 2: (0, 0, 0.0, "flag"), 3: (0, 0, 1.0, "none")}
    ranked = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "y" * 50), (1, 3, "z")], "query_id int, rank int, text string")
    assert answers.context(ranked, 30).collect()[0].context == "[1] " + "x" * 10


def test_cache_and_upsert(spark):
    texts = spark.createDataFrame([(1, "k1", "a"), (2, "k2", "b"), (3, "k2", "b")], "row_id int, key string, text string")
    cache = spark.createDataFrame([("k1", [1.0])], "key string, vector array<double>")
    planned = caching.plan(texts, cache)
    rows, new = caching.embed_through(planned, lambda m: m.withColumn("vector", F.array(F.lit(2.0))))
    assert sorted((r.row_id, r.vector[0]) for r in rows.collect()) == [(1, 1.0), (2, 2.0), (3, 2.0)] and new.count() == 1
    s = caching.stats(planned).collect()[0]
    assert (s.hits, s.misses, s.to_embed, s.hit_rate) == (1, 2, 1, 0.3333)
    index = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "chunk_id int, vector array<double>")
    more = spark.createDataFrame([(2, [9.0, 9.0])], "chunk_id int, vector array<double>")
    assert sorted((r.chunk_id, r.vector[0]) for r in retrieval.upsert(index, more, dimensions=2).collect()) == [(1, 1.0), (2, 9.0)]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.upsert(index, more, dimensions=3).collect()
    assert len(retrieval.embed(spark.createDataFrame([("a b a",)], "text string"), 8).collect()[0].vector) == 8


def test_registry_and_paths(spark, tmp_path):
    assert "html" in plans.available("chunker") and plans.create("retriever", "bm25") is retrieval.bm25
    with pytest.raises(ValueError):
        plans.create("chunker", "none")
    for bad in ("../x", "/etc/x", "a/../../x", "file://x"):
        with pytest.raises(ValueError):
            sources.safe_path("/data", bad)
    (tmp_path / "a.txt").write_bytes(b"ok \xff end")
    assert [r.text for r in sources.read_texts(spark, str(tmp_path)).collect()] == ["ok � end"]
    assert sources.exists(spark, str(tmp_path)) and sources.delete(spark, str(tmp_path)) and not sources.delete(spark, str(tmp_path))


def test_long_columns_are_windowed_from_ranges(spark):
    sheet = [(d, r, None if r % 7 == 0 else " ".join(f"w{d}_{r}_{k}" for k in range(r % 5)) or "nan", "x  y " * 300 if r == 9000 else "z") for d in (1, 2) for r in range(0, 9500, 1 if d == 1 else 97)]
    df = spark.createDataFrame(sheet, "d int, r int, `a b` string, c string").repartition(5)
    for size, overlap, exact in ((50, 0, False), (50, 0, True), (7, 3, False), (1, 0, True), (100_000, 10, False)):
        c = WindowConfig(size=size, overlap=overlap, boundary=False, exact_overlap=exact)
        got = [(x.doc_id, x.header, x.text) for x in chunkers.chunk_columns(df, ["a b", "c"], "r", F.col("d"), c).orderBy("doc_id", "chunk_index").collect()]
        want = []
        for d in (1, 2):
            for k, h in ((2, "a b"), (3, "c")):
                w = f"Column: {h} {' '.join(x[k] for x in sheet if x[0] == d and x[k] and x[k] != 'nan')}".split()
                want += [(d, h, " ".join(w[a:b])) for a, b in spans(w, c)]
        assert got == want
    assert chunkers.chunk_columns(df.limit(0), ["a b", "c"], "r", F.col("d")).count() == 0


def test_traversal_past_hubs(spark):
    r = random.Random(3)
    pairs = [("hub", f"n{k}") for k in range(1200)] + [(f"n{r.randrange(1200)}", f"n{r.randrange(1200)}") for _ in range(700)] + [("n1", "hub"), ("far", "n2"), ("far", "end"), (None, "n3")]
    edges = spark.createDataFrame([(a, b, f"c{k % 90}" if k % 4 else None) for k, (a, b) in enumerate(pairs)], "src string, dst string, chunk_id string").repartition(3)
    entry = spark.createDataFrame([(1, "end"), (2, "n7"), (2, "hub"), (3, "nowhere"), (2, "hub")], "query_id int, id string")
    near = {}
    for a, b in pairs:
        if a is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, front = {(q.query_id, q.id): 0 for q in entry.collect()}, {(q.query_id, q.id) for q in entry.collect()}
    for hop in (1, 2, 3, 4):
        front = {(q, b) for q, a in front for b in near.get(a, ())} - set(want)
        want |= dict.fromkeys(front, hop)
    for least in (10, 1 << 16):
        assert sorted((x.query_id, x.node, x.hop) for x in graph.reach(entry, edges, 4, least).filter("node IS NOT NULL").collect()) == sorted((q, n, h) for (q, n), h in want.items())
    chunks = lambda least: sorted(map(tuple, graph.traverse(entry, edges, 2, least).collect()))
    plain, links = {}, list(map(tuple, edges.collect()))
    for (q, n), h in want.items():
        for a, b, c in links if h <= 2 else ():
            if c is not None and n in (a, b):
                plain[q, c] = min(h, plain.get((q, c), 9))
    assert chunks(10) == chunks(1 << 16) == sorted((q, c, h) for (q, c), h in plain.items())
    large = graph.hubs(edges, 10)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < large.count() <= parts and graph.hubs(edges.limit(0)) is None
    held = graph.blocked(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")), "to", graph.hubs(edges.filter("src = 'hub'"), 50))
    assert held.filter("node = 'hub'").groupBy("block").count().agg(F.max("count")).first()[0] < 700
    assert graph.reach(entry, edges.limit(0), 2).count() == 4


def test_entry_nodes_of_a_run_that_very_many_texts_hold(spark):
    """Such a run is dealt over blocks; only runs as long as names are made."""
    asked = spark.createDataFrame([(i, f"From egypt, in Africa {i % 3}") for i in range(400)] + [(400, "to Saudi Arabia or A B C D E F G"), (401, None), (402, "")], "query_id int, text string")
    named = spark.createDataFrame([("n1", "Egypt"), ("n2", "EGYPT"), ("n3", "saudi arabia"), ("n4", "a b c d e f g"), ("n5", "a b c d e f h"), ("n6", ""), ("n7", None)], "id string, name string")
    want = {(i, n) for i in range(400) for n in ("n1", "n2")} | {(400, "n3"), (400, "n4")}
    for least in (20, 1 << 16):
        got = graph.entry_nodes(asked, named, least=least)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    large = graph._frequent(spark.createDataFrame([("egypt",)] * 100 + [("x",)], "node string"), 20)
    assert [r.node for r in large.collect()] == ["egypt"]


def test_bm25_takes_each_text_apart_once(spark):
    """And leaves no lists behind."""
    import os

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    chunks = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(40)] + [(40, None), (41, "")], "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "word3"), (2, "none at all")], "query_id int, query string")
    found = retrieval.bm25(asked, chunks.select("chunk_id", seen("text").alias("text")), 3).collect()
    assert read.value == 42
    assert sorted((r.query_id, r.chunk_id) for r in found) == [(1, 3), (1, 10), (1, 17), (2, 0), (2, 1), (2, 2)]
    folder = graph._checkpoint_dir(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("lists-")]


def test_a_step_deals_out_no_pairs_of_queries_and_nodes(spark):
    """Queries that stand at one hub: their pairs with its neighbours are made by the last join, and not shuffled after it."""
    n = 300
    edges = spark.range(n).select(F.concat(F.lit("s"), "id").alias("to"), F.lit("hub").alias("node"))
    both = graph.blocked(edges, "to", None)
    front = edges.select(F.col("to").alias("query_id"), "node").localCheckpoint()
    seen = front.select("query_id", F.col("query_id").alias("node"), F.lit(0).alias("hop")).unionByName(front.withColumn("hop", F.lit(1)))
    step = graph._step(front, both, seen, None)
    assert len(step.collect()) == n * (n - 1)
    final = step._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    last = final[: final.index("Join")]
    assert "Final Plan" in last and "Exchange" not in last and "Shuffle" not in last and "Aggregate" not in last


def test_a_step_broadcasts_no_queries_or_nodes(spark, monkeypatch):
    """What grows with the queries or the graph doesn't pass through the driver, however small its tables are on disk."""
    edges = spark.createDataFrame([("s1", "hub"), ("s2", "hub"), ("c1", "hub"), ("hub", "top")], "src string, dst string")
    entry = spark.createDataFrame([(1, "s1"), (2, "s2")], "query_id int, id string")
    made, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: made.append(df) or cut(df))
    made.append(graph.reach(entry, edges, 2))
    assert sorted(tuple(r) for r in made[-1].collect()) == sorted((q, n, h) for q, own, other in ((1, "s1", "s2"), (2, "s2", "s1")) for n, h in ((own, 0), ("hub", 1), (other, 2), ("c1", 2), ("top", 2)))
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_embedding_counts_terms(spark):
    """Counts by the first byte of a term's digest; the places aren't searched for one by one."""
    import hashlib

    texts = ["one two two Dreißig_3", "", None, "  ", "x " * 700 + "y", "ÄÖ 東京 東京"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for dimensions in (7, 64):
        made = retrieval.embed(rows.repartition(2), dimensions)
        assert "array_remove" not in made._jdf.queryExecution().executedPlan().toString()
        for r in made.collect():
            want = [0.0] * dimensions
            for w in re.findall(r"\w+", (r.text or "").lower()):
                want[hashlib.md5(w.encode()).digest()[0] % dimensions] += 1
            assert r.vector == want
    assert made.schema["vector"].dataType.simpleString() == "array<float>"
