"""The pipeline's stages on odd and ordinary documents."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, odd, sample, tmp_path):
    more = odd.withColumn("n_chars", F.length("text").cast("long"))
    docs = sample.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(more).unionByName(sample.limit(20).withColumn("doc_id", F.col("doc_id") + 5000))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = after
        if name != "packed":
            assert after.columns == sample.columns
            docs = after
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert not {1, 2, 3, 8} & ids("language") and {5, 6} <= ids("language")
    assert 6 not in ids("near_duplicates") and 5 in ids("near_duplicates") and not {i for i in ids("near_duplicates") if i >= 5000}
    assert ids("repeated_passages") == ids("near_duplicates") == ids("personal_data") == ids("packed")
    assert seen["personal_data"].filter(F.col("n_chars") != F.length("text")).count() == 0
    assert seen["personal_data"].filter(F.col("text").rlike(r"[a-z]+\.[0-9]+@mail[0-9]")).count() == 0
    full = seen["packed"].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 1024").count() == 0


def test_middle_stages_equal_brute_force(spark, odd, sample, tmp_path):
    """Near duplicates and repeated passages of what each stage gets, and masked spans, against plain versions."""
    import hashlib

    import test_duplicates as brute
    from textloom.llm import pii

    more = odd.withColumn("n_chars", F.length("text").cast("long"))
    docs = sample.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(more).unionByName(sample.limit(40).withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat(F.lit("one more word "), F.col("text"))))
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    near = stage("near_duplicates", docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {i for i, _, _, keep in brute.brute_near([r for r in rows if r[0] is not None], 5) if keep}
    assert {(r.doc_id, r.text) for r in near.collect()} == {(i, x) for i, x in rows if i is None or i in kept}
    cut = stage("repeated_passages", near)
    want = {(i, digest) for i, _, gone, digest in brute.brute_removed([(r.doc_id, r.text) for r in near.collect()], 50)}
    said = lambda x: hashlib.sha256(" ".join(brute.WORD.findall(x or "")).encode()).hexdigest()
    assert {(r.doc_id, said(r.text)) for r in cut.collect()} == want
    masked = {r.doc_id: r.text for r in stage("personal_data", cut).collect()}
    spans = {r.doc_id: r.spans for r in pii.find(cut).collect()}
    for r in cut.collect():
        text, at = r.text or "", 0
        out = []
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x)), key=lambda s: (s[1], s[2], s[0])):
            out.append("" if a < at else text[at:a] + f"<{kind}>")
            at = max(at, b)
        assert (masked[r.doc_id] or "") == "".join(out) + text[at:]
