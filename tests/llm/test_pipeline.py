"""The pipeline's stages: each against brute force on planted cases, and the whole on the smallest tables."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tactus.llm import queries, toxicity

STAGES = dict(corpus_pipeline.STAGES)


def words(rng, n):
    return " ".join(f"{rng.randrange(16**5):05x}" for _ in range(n))


def changed(text, at):
    w = text.split()
    w[at] = "other"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(3)
    a, b, c, d, item = (words(rng, n) for n in (40, 30, 35, 60, 55))
    texts = {
        0: f"{a}\n{b}",
        1: f"{changed(a, 7)}\n{c}",
        2: d,
        3: changed(d, 30),
        4: words(rng, 60),
        5: f"{words(rng, 20)} {item} {words(rng, 9)}",
        6: None,
        7: "",
        8: f"{words(rng, 25)}\n\n--\n{b}",
    }
    at = tmp_path_factory.mktemp("planted")
    rows = [(i, t, "en", "s", len(t or ""), i * 2) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, words(rng, 50))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return spark.read.parquet(f"{at}/documents.parquet"), str(at), texts


def test_line_dedup_stage(spark, planted):
    docs, at, texts = planted
    got = {r.doc_id: r for r in STAGES["line dedup"](spark, docs, at).collect()}
    want = dict(texts)
    want[1] = texts[1].split("\n")[1]
    want[3] = ""
    want[8] = "\n".join(texts[8].split("\n")[:3])
    assert {i: r.text for i, r in got.items()} == want and all(r.key == 2 * i and r.n_chars == (len(want[i]) if want[i] is not None else None) for i, r in got.items())


def test_near_copies_stage(spark, planted):
    docs, at, texts = planted

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    near = {j for j in sets for i in sets if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near == {3}
    assert {r.doc_id for r in STAGES["n-gram Jaccard join"](spark, docs, at).collect()} == set(texts) - near


def test_benchmark_and_encoding_stages(spark, planted):
    import sentencepiece

    docs, at, texts = planted
    clean = STAGES["benchmark decontamination"](spark, docs, at)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(texts) - {5}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(queries.PIECES))
    for r in STAGES["SentencePiece"](spark, docs, at).collect():
        assert r.same and np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id] or "")


def test_toxicity_stage(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (queries.table(spark, sf_dir, t) for t in ("documents", "labels"))
    kept = {r.doc_id for r in STAGES["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 0").select("doc_id").collect()}


def test_stages_and_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece"]
    n = docs.count()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0.6 * n < len(out) <= n and all(r.same for r in out)
