"""Frames, factors, neighbours and further statistics."""

import math

import pytest
from pyspark.sql import functions as F

from spanforge.operators import frames, stats


def test_factor(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    f = frames.Factor.of(df, "x")
    assert f.levels == ["a", "b"] and [r.i for r in df.select(f.index("x").alias("i")).collect()] == [1, 0, 1, None]
    assert [(r.x, r.n) for r in frames.Factor(["c", "a", "b"]).tabulate(df, "x").orderBy("level").collect()] == [("c", 0), ("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        frames.Factor(["a", "a"])
    with pytest.raises(ValueError):
        frames.Factor.of(df, "x", most=1)


def test_frames(spark):
    df = spark.createDataFrame([("r1", 1, 2), ("r2", 3, 4)], "k string, a long, b long")
    assert sorted(tuple(r) for r in frames.transpose(df, "k").collect()) == [("a", 1, 3), ("b", 2, 4)]
    assert [r.total for r in frames.row_sums(df, ["a", "b"]).orderBy("k").collect()] == [3, 7] and tuple(frames.column_sums(df, ["a", "b"]).first()) == (4, 6)
    assert frames.bind_columns(["k"], df.select("k", "a"), df.select("k", "b")).orderBy("k").first().b == 2 and frames.bind_rows(df, df).count() == 4
    n = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "n string, i long")
    assert [r.u for r in frames.make_unique(n, "n", ["i"], "u").orderBy("i").collect()] == ["x", "x_1", "y"]
    p = spark.createDataFrame([("ab", 1), ("abc", 2), ("b", 3)], "p string, v long")
    t = spark.createDataFrame([("abcd",), ("b",), ("",)], "t string")
    assert sorted((r.t, r.p) for r in frames.prefix_join(t, "t", p, "p", 5).collect()) == [("abcd", "ab"), ("abcd", "abc"), ("b", "b")]
    w = spark.createDataFrame([("AAC",), ("AAG",), ("TAG",), ("AAC",)], "w string")
    assert sorted(tuple(r) for r in frames.mismatch_graph(w, "w").collect()) == [("AAC", "AAG"), ("AAG", "TAG")]
    assert len(frames.permutations([1, 2, 3])) == 6
    out, seen = frames.observe(df, n=F.count("*"), top=F.max("a"))
    out.collect()
    assert seen.get == {"n": 2, "top": 3}


def test_more_statistics(spark):
    p = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.5)], "k string, p double")
    got = {r.k: r.p for r in stats.combine_p_values(p, ["k"], "p").collect()}
    assert math.isclose(got["b"], 0.5) and math.isclose(got["a"], 0.02 * (1 - math.log(0.02)))
    m = stats.mantel_haenszel(spark.createDataFrame([(10, 5, 3, 12)], "a long, b long, c long, d long"), "a", "b", "c", "d").first()
    assert math.isclose(m.odds_ratio, 8) and math.isclose(m.chi2, 29 / 30 * (30 * (10 * 12 - 5 * 3) ** 2) / (15 * 15 * 13 * 17))
    t = spark.range(50).select(F.lit("r").alias("k"), F.col("id").alias("pos"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    s = t.withColumn("pos", F.col("pos") + 2)
    best = max(stats.cross_correlation(t, s, ["k"], "pos", "v", range(-3, 4)).collect(), key=lambda r: r.r)
    assert best.lag == 2 and math.isclose(best.r, 1)
    o = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, v double")
    assert [r.v for r in stats.iqr_outliers(o, ["k"], "v").where("outlier").collect()] == [100]
    assert math.isclose(stats.digamma(1), -0.5772156649015329, abs_tol=1e-10) and math.isclose(stats.digamma(0.5), -1.9635100260214235, abs_tol=1e-10)
    assert math.isclose(stats.posterior_mean_fold_change(spark.createDataFrame([(5.0, 5.0)], "a double, b double"), "a", "b").first().lfc, 0)
    assert sorted(r.ecdf for r in stats.ecdf(o, ["k"], "v").collect()) == [0.2, 0.4, 0.6, 0.8, 1.0]
