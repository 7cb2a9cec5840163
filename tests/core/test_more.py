"""Graphs, value mapping, conditions and SAM text against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import region as R
from spanforge.functions import text as X
from spanforge.operators import frames, graph, joins, program, stats, tracks
from spanforge.operators.table import check_expression, scope, split_condition
from spanforge.sources import sam
from spanforge.sources import text as files

PARTS = "array<struct<s:bigint,e:bigint>>"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, None), (5, 5)]
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.group for r in graph.union_find(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert graph.union_find(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spliced_clusters(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        s = rng.randrange(3000)
        parts, at = [], s
        for _ in range(rng.randint(1, 3)):
            parts.append((at, at + rng.randint(3, 20)))
            at = parts[-1][1] + rng.randint(5, 60)
        rows.append((i, rng.choice("AB"), rng.choice("+-"), parts))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1:3] == rows[b][1:3] and any(p[0] < q[1] and q[0] < p[1] for p in rows[a][3] for q in rows[b][3]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    want = sorted((rows[g][1], rows[g][2], group.count(g), min(p[0] for i, r in enumerate(rows) if group[i] == g for p in r[3])) for g in set(group))
    df = spark.createDataFrame(rows, f"id long, ref string, strand string, parts {PARTS}")
    got = sorted((r.ref, r.strand, r.n, r.parts[0].s) for r in graph.cluster_spliced(df, "id").collect())
    assert got == want and max(n for _, _, n, _ in want) > 2


def test_value_mapping(spark):
    v = F.array(F.lit("exon"), F.lit("intron_a"), F.lit("gap"))
    cases = [("regex", "int.*", "I"), ("contains", "on", "N"), ("equals", "gap", "G"), ("table", {"exon": "T"}, None)]
    got = {c: value(spark, program.map_values(v, cases, c, "none")) for c in program.CHAINS}
    assert got == {"None": ["G", "I", "N", "T"], "FirstForEach": ["G", "I", "N"], "FirstForAny": ["I"]}
    assert value(spark, program.map_values(F.array(F.lit("x")), cases, "None", "none")) == ["none"] and value(spark, program.map_values(F.array(F.lit("x")), cases)) == []
    with pytest.raises(ValueError):
        program.map_values(v, cases, "Other")


def test_conditions(spark):
    df = spark.range(3).withColumn("name", F.lit("x"))
    assert check_expression(df, "id + 1") is None and "nothing" in check_expression(df, "nothing > 2") and check_expression(df, "id +") is not None
    got = split_condition("a = 1 AND (b = 2 or c = 'x and y') OR d between 1 and 3 and e like 'it''s or'")
    assert got == [("AND", "a = 1"), ("AND", "(b = 2 or c = 'x and y')"), ("OR", "d between 1 and 3"), ("AND", "e like 'it''s or'")]
    with pytest.raises(ValueError):
        scope(spark, "Own")


def test_sam(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "r1\t16\tchr1\t101\t60\t2S3M1I2M4D2M10N3M\t*\t0\t0\tNNACGTCAGGTTT\t*\tNH:i:3\tMD:Z:1T2A0^CCCC0A4", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*", "r3\t128\t2\t6\t0\t4=1X\t*\t0\t0\tACGTA\t*"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    got = {r.name: r for r in files.load(spark, str(tmp_path / "x.sam")).collect()}
    assert set(got) == {"r1", "r3"}
    r = got["r1"]
    assert (r.ref, r.strand) == ("1", "-") and [(p.s, p.e) for p in r.parts] == [(100, 111), (121, 124)]
    d = r.distincts[0]
    assert d.multiplicity == 3 and [(v.pos, v.genomic, v.read, v.second) for v in d.vars] == [(1, "T", "C", False), (4, "A", "A", False), (5, "A", "G", False)]
    assert [(p.s, p.e) for p in got["r3"].parts] == [(5, 10)] and got["r3"].distincts[0].multiplicity == 1 and got["r3"].distincts[0].vars == []
    assert value(spark, sam.aligned_bases(F.lit("2S3M1I2M4D2M10N3M"), F.lit("NNACGTCAGGTTT"))) == "ACGCAGGTTT"


def test_liftover_regions(spark):
    chain = spark.createDataFrame([("A", 0, 100, "B", 1000, "+"), ("A", 200, 300, "B", 2000, "+"), ("A", 400, 500, "C", 0, "-"), ("A", 450, 500, "D", 0, "+")], "ref string, s long, e long, to_ref string, to_s long, to_strand string")
    rows = [(1, "A", "+", [(10, 20), (210, 220)]), (2, "A", "+", [(10, 20), (110, 120)]), (3, "A", "-", [(410, 420)]), (4, "A", "+", [(460, 470)]), (5, "X", "+", [(1, 2)]), (6, "A", "+", [(10, 20), (410, 420)])]
    got = {r.id: (r.status, r.ref, r.strand, r.parts and [(p.s, p.e) for p in r.parts]) for r in joins.liftover_regions(spark.createDataFrame(rows, f"id long, ref string, strand string, parts {PARTS}"), chain, "id").collect()}
    assert got == {1: ("ok", "B", "+", [(1010, 1020), (2010, 2020)]), 2: ("partial", None, None, None), 3: ("ok", "C", "+", [(80, 90)]), 4: ("multimapped", None, None, None), 5: ("unmapped", None, None, None), 6: ("partial", None, None, None)}


def test_small_functions(spark):
    a, b = F.array(R.part(0, 10), R.part(20, 30)), F.array(R.part(5, 25))
    assert value(spark, R.intersect_length(a, b)) == 10
    assert sorted(value(spark, X.scramble(F.lit("banana"), 3))) == sorted("banana")
    words = [(1, "g", "ACGT"), (2, "g", "ACGA"), (3, "g", "TCGA"), (4, "h", "ACGT"), (5, "g", "ACGT"), (6, "g", "ACG")]
    near = frames.near_pairs(spark.createDataFrame(words, "k long, g string, w string"), ["g"], "k", "w").collect()
    assert sorted((r.a.k, r.b.k) for r in near) == [(1, 2), (1, 5), (2, 3), (2, 5)]
    p = {r.z: r.p for r in spark.createDataFrame([(0.0,), (1.959964,), (-3.0,)], "z double").select("z", stats.normal_two_sided(F.col("z")).alias("p")).collect()}
    assert abs(p[0.0] - 1) < 1e-6 and abs(p[1.959964] - 0.05) < 1e-6 and abs(p[-3.0] - 0.0026998) < 1e-6
    lines = spark.createDataFrame([("a;b",), ("1;x",), ("a;b",), ("2;y",)], "value string").coalesce(1)
    assert [tuple(r) for r in files.read_csv_lines(spark, lines, ["a;b", "1;x"]).collect()] == [(1, "x"), (2, "y"), (None, "b")]
    runs = spark.createDataFrame([("A", "+", [(0, 70_000)]), ("A", "+", [(65_530, 65_540), (200_000, 200_010)])], f"ref string, strand string, parts {PARTS}")
    assert sorted((r.s, r.e, r.depth) for r in tracks.coverage(runs, F.lit(1)).collect()) == [(0, 65_530, 1), (65_530, 65_540, 2), (65_540, 70_000, 1), (200_000, 200_010, 1)]
