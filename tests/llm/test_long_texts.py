"""Texts longer than a block go through every operator on texts."""

import random

from pyspark.sql import functions as F

from spanforge.llm import host_rules, jaccard, katz, line_dedup, packing, quality, suffix_dedup, winnow
from spanforge.llm.queries import remainder


def test_long_texts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(40000)}" for _ in range(760_000)]
    text = " ".join(words)
    assert len(text) > 4 << 20
    other = "\n".join(" ".join(words[i : i + 40]) for i in range(0, 20_000, 40))
    rows = [(1, text, "a"), (2, text, "b"), (3, "short", "a"), (4, other, "a"), (5, "é" * 50_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "doc_id")
    n = {r[0]: len(r[1].encode()) for r in rows}
    gone = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect()}
    assert gone[1] == gone[2] == (n[1], n[1], 1) and gone[3] == (5, 0, 0) and gone[5] == (n[5], n[5], 1)
    assert gone[4][:2] == (n[4], 0)  # its lines are shorter than 400 bytes
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    scored = {r.doc_id: r for r in katz.score_texts(docs, held_out=remainder(10) == 0).collect()}
    assert scored[1].n_tokens == 760_001 and abs(scored[1].score - scored[2].score) < 1e-3
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert lines == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (500, 0), 5: (1, 0)}
    counts = {r.doc_id: (r.n_words, r.kept) for r in host_rules.judge(docs).collect()}
    assert counts[1] == (760_000, True) and counts[3] == (1, False)
    items = spark.createDataFrame([(7, " ".join(words[500_000:500_012]))], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_items) for r in winnow.contamination(docs, items).collect()}
    assert found == {1: (12, 1), 2: (12, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    packed = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in packed) and len(packed) == 5
    assert quality.features([text.encode(), b""])[1].tolist() == [0] * quality.FEATURES
