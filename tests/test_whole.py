"""Queries without SQL against brute force on small tables: nothing is left out."""

import difflib
import random
import time

from pyspark.sql import functions as F

from tactus.functions import sequences
from tactus.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_block_similarity(spark, tmp_path):
    same = "one long passage of the same words, " * 3
    docs = [(1, same + "ending in a way"), (2, same + "größer als zuvor"), (45, "short text"), (90, "x" * 400), (7, None)]
    items = [(3, same + "that ends otherwise"), (41, "short test"), (160, "größer"), (7, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.ratio for r in QUERIES["block_similarity"](spark, str(tmp_path)).collect()}
    near = [(d, i, x, y) for d, x in docs for i, y in items if x and y and 2 * min(len(x), len(y)) >= max(len(x), len(y))]
    want = {(d, i): round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), 9) for d, i, x, y in near}
    assert len(want) == 4 and {k: v for k, v in got.items() if v is not None} == want
    assert {k for k, v in got.items() if v is None} == {(d, i) for d, x in docs for i, y in items if (x is None) != (y is None)}


def test_block_similarity_of_copies(spark, tmp_path):
    """Documents of one file are dealt out, and all copies of a text get its ratio."""
    spark.createDataFrame([(i, "the same text" if i % 2 else f"another text {i}") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the same text"), (2, "the other text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["block_similarity"](spark, str(tmp_path))
    got = [(r.doc_id, r.item_id, r.ratio) for r in rows.collect()]
    assert len(got) == len({x[:2] for x in got}) == 80 and {r for d, i, r in got if d % 2 and i == 1} == {1.0}
    assert rows.rdd.getNumPartitions() > 1


def test_blocks_are_those_of_difflib():
    """Ratios of odd, repeating and partly equal texts, without difflib's cost: few characters are asked for long texts."""
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc d", "abcdefghij é日"])
        x, y = ("".join(rng.choice(letters) for _ in range(rng.randint(0, n))) for n in (90, 140))
        if rng.random() < 0.4:
            y = x[rng.randint(0, 20) :] + y[:30] + x[: rng.randint(0, 60)]
        assert sequences.Blocks(y).ratio(x) == difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    words = [f"{rng.randrange(16**5):05x}" for _ in range(40)]
    x, y = (" ".join(rng.choice(words) for _ in range(300)) for _ in range(2))

    def cost(ratio):
        began = time.process_time()
        return ratio(), time.process_time() - began

    (want, slow), (got, fast) = cost(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio), cost(lambda: sequences.Blocks(y).ratio(x))
    assert got == want and fast < slow


def test_decode_note_runs(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").where("event_id < 200").withColumn("user_id", F.col("user_id") + 35)
    events.write.parquet(f"{tmp_path}/events.parquet")
    sizes = {str(r.user_id): r["count"] for r in events.groupBy("user_id").count().collect()}
    got = {(r.doc_id, r.phrase_id) for r in QUERIES["decode_note_runs"](spark, str(tmp_path)).collect()}
    assert max(map(int, sizes)) >= 40 and got == {(u, k) for u, n in sizes.items() for k in range((n + 5) // 6)}
