"""Region algebra against sets of positions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import region as R

PARTS = "array<struct<s:bigint,e:bigint>>"
regions = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=5).map(lambda x: [(s, s + n) for s, n in x])


def positions(parts):
    return {p for s, e in parts for p in range(s, e)}


def parts_of(pos):
    out = []
    for p in sorted(pos):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(regions, regions), min_size=40, max_size=40))
def test_against_positions(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {PARTS}, b {PARTS}")
    df = df.withColumns({"a": R.normalize("a"), "b": R.normalize("b")})
    out = df.select(
        "i", "a", "b", R.union("a", "b").alias("union"), R.intersect("a", "b").alias("intersect"), R.subtract("a", "b").alias("subtract"), R.introns("a").alias("introns"),
        R.intersects("a", "b").alias("meets"), R.contains("a", "b").alias("contains"), R.length("a").alias("length"),
        R.induce_region("a", "b").alias("induced"), R.map_region("a", F.array(R.part(2, 5), R.part(7, 9))).alias("mapped"), R.parse(R.to_text("a")).alias("again"),
        R.extend("a", 3, 2).alias("longer"), R.extend("a", -2, -1).alias("shorter"), F.transform(F.sequence(F.lit(0), F.lit(80)), lambda p: R.induce_position("a", p)).alias("each"),
    ).collect()
    for r in out:
        a, b = positions(pairs[r.i][0]), positions(pairs[r.i][1])
        t = lambda x: [tuple(p) for p in x]
        assert t(r.a) == parts_of(a) == t(r.again) and t(r.union) == parts_of(a | b) and t(r.intersect) == parts_of(a & b) and t(r.subtract) == parts_of(a - b)
        assert r.meets == bool(a & b) and r.length == len(a)
        assert r.contains == all(any(s <= q and f <= e for s, e in parts_of(a)) for q, f in parts_of(b))
        assert t(r.introns) == parts_of(set(range(min(a), max(a) + 1)) - a if a else set())
        order = sorted(a)
        where = {p: i for i, p in enumerate(order)}
        assert t(r.induced) == parts_of({where[p] for p in a & b})
        assert t(r.mapped) == parts_of({order[i] for i in (2, 3, 4, 7, 8) if i < len(order)})
        assert list(r.each) == [where.get(p) for p in range(81)]
        if a:
            assert positions(r.longer) == a | set(range(min(a) - 3, min(a))) | set(range(max(a) + 1, max(a) + 3))
            assert positions(r.shorter) == set(order[2 : len(order) - 1])


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_literals(spark):
    parse = lambda x: R.parse(F.lit(x))
    text = lambda c: value(spark, R.to_text(c))
    assert text(R.union(parse("0-10"), parse("10-20"))) == "0-20"
    assert text(R.union(parse("0-10|20-30"), parse("5-15|25-40"))) == "0-15|20-40"
    assert text(R.invert_within(parse("0-10|20-30"), 0, 30)) == "10-20"
    assert not value(spark, R.intersects(parse("0-10|20-30"), parse("12-18")))
    assert value(spark, R.map_stranded(F.lit("-"), parse("0-10|20-30"), 0)) == 29 and value(spark, R.map_stranded(F.lit("-"), parse("0-10|20-30"), 19)) == 0
    assert text(parse("1,000-2,000|3000")) == "1000-2000|3000-3001"
    assert text(R.reverse(parse("0-2|5-9"), 10)) == "1-5|8-10" and text(R.flank(F.lit("-"), parse("5-9"), 2, 1)) == "7-11"
    rows = spark.createDataFrame([("10", "+"), ("2", "-"), ("2", "+"), ("X", "+"), ("chr3", "")], "ref string, strand string").withColumn("parts", F.array(R.part(1, 2)))
    assert [(r.ref, r.strand) for r in rows.orderBy(*R.location_order("ref", "strand", "parts")).collect()] == [("2", "+"), ("2", "-"), ("chr3", ""), ("10", "+"), ("X", "+")]
    assert value(spark, R.extract_sequence(parse("1-3|5-6"), F.lit("ACGTACG"))) == "CGC"
    assert value(spark, R.ucsc_reference(F.lit("MT"))) == "chrM" and value(spark, R.trim_reference(F.lit("chrM"))) == "MT"
