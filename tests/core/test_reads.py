"""Reads payloads, JSON, patterns and alignments."""

import pytest
from pyspark.sql import functions as F

from spanforge.functions import dynamic
from spanforge.operators import reads

PARTS = "array<struct<s:bigint,e:bigint>>"


def frame(spark, rows):
    return spark.createDataFrame(rows, f"ref string, strand string, parts {PARTS}, distincts {reads.DISTINCTS}")


M = lambda p, g, r, second=False: ("M", p, g, r, second)
ROWS = [("1", "+", [(0, 10)], [([2.0, 1.0], 1, [M(0, "T", "C"), M(1, "A", "G"), M(5, "T", "C")]), ([4.0, 0.0], 3, [])]), ("2", "-", [(5, 9)], [([1.0, 1.0], 2, [M(1, "A", "G", True)])])]


def test_parse_range():
    assert reads.parse_range("1,3:5", 8) == [1, 3, 4, 5] and reads.parse_range("-2:-1", 8) == [6, 7] and reads.parse_range("all", 3) == [0, 1, 2]
    assert reads.parse_range("b,0", 2, ["a", "b"]) == [1, 0]
    with pytest.raises(ValueError):
        reads.parse_range("9", 8)
    with pytest.raises(ValueError):
        reads.parse_range("x", 8)


def test_conditions_and_filters(spark):
    df = frame(spark, ROWS)
    counts = lambda d: [[list(x.counts) for x in r.distincts] for r in d.orderBy("ref").collect()]
    assert counts(reads.select_conditions(df, [1])) == [[[1.0], [0.0]], [[1.0]]]
    assert counts(reads.merge_conditions(df, [[0, 1]])) == [[[3.0], [4.0]], [[2.0]]]
    assert counts(reads.unique_mapping(df)) == [[[2.0, 1.0]]] and counts(reads.unique_mapping(df, 2)) == [[[2.0, 1.0]], [[1.0, 1.0]]]
    assert counts(reads.has_mismatches(df, "T", "C", 2)) == [[[2.0, 1.0]]]
    totals = [list(r.t) for r in df.orderBy("ref").select(reads.condition_totals(F.col("distincts"), "Unique", 2).alias("t")).collect()]
    assert totals == [[2, 1], [0, 0]]
    assert [r.ref for r in reads.rename_references(df, {"1": "one"}).orderBy("ref").collect()] == ["2", "one"]


def test_mismatch_features(spark):
    d = F.col("distincts")
    got = frame(spark, ROWS).orderBy("ref").select(
        reads.mismatch_count(d).alias("n"), reads.conversion_count(d, "T", "C").alias("tc"), reads.leading_mismatches(d).alias("lead"), reads.mismatch_strings(d, "TypePosition").alias("s")
    ).collect()
    assert [(r.n, r.tc, r.lead) for r in got] == [(3, 2, 2), (1, 1, 0)] and list(got[0].s) == ["0:T>C", "1:A>G", "5:T>C"]


def test_merge_storages(spark):
    a = frame(spark, ROWS)
    b = frame(spark, [("1", "+", [(0, 10)], [([7.0, 0.0], 3, [])]), ("3", "+", [(1, 2)], [([5.0, 5.0], 1, [])])])
    got = {r.ref: [list(d.counts) for d in r.distincts] for r in reads.merge_storages([a, b], [2, 2]).collect()}
    assert got == {"1": [[2, 1, 0, 0], [4, 0, 7, 0]], "2": [[1, 1, 0, 0]], "3": [[0, 0, 5, 5]]}


def test_transcript_parts(spark):
    t = spark.createDataFrame([("g", "1", "-", [(0, 10), (20, 30)], 5, 25), ("g", "1", "-", [(28, 40)], -1, -1)], f"gene_id string, ref string, strand string, parts {PARTS}, coding_start bigint, coding_end bigint")
    g = reads.genes_of(t).first()
    assert [tuple(p) for p in g.parts] == [(0, 10), (20, 40)] and (g.coding_start, g.coding_end) == (5, 25)
    c = [F.col(x) for x in ("parts", "coding_start", "coding_end")]
    r = t.limit(1).select(reads.coding_parts(*c).alias("cds"), reads.utr_parts(F.col("strand"), *c, five=True).alias("u5"), reads.utr_parts(F.col("strand"), *c, five=False).alias("u3")).first()
    assert [[tuple(p) for p in x] for x in (r.cds, r.u5, r.u3)] == [[(5, 10), (20, 25)], [(25, 30)], [(0, 5)]]


def test_json_patterns_alignment(spark):
    df = spark.createDataFrame([('{"a": "1", "b": {"c": [5]}}', '{"a": "2"}')], "x string, y string")
    r = df.select(dynamic.get(F.col("x"), ".b.c[0]").alias("g"), dynamic.cascade(F.col("y"), F.col("x"), path=".b.c[0]").alias("c"), dynamic.get(dynamic.merge(F.col("x"), F.col("y")), ".a").alias("m")).first()
    assert (r.g, r.c, r.m) == ("5", "5", "2")
    found = dynamic.find_patterns(spark.createDataFrame([("abcab",), (None,), ("zz",)], "t string"), "t", ["ab", "bc", "zzz"]).collect()
    assert sorted(map(list, (r.found for r in found))) == [[], [], ["ab", "bc"]]
    pairs = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "AGT"), ("TTACG", "ACGAA"), ("", "AA")], "a string, b string")
    score = lambda mode: [r.score for r in dynamic.align(pairs, "a", "b", mode=mode).collect()]
    assert score("global") == [4, 2, -1, -2] and score("local") == [4, 2, 3, 0]
