"""Interval views of the standard tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import region as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-part reads: (ref, strand, parts, cnt, multiplicity, sample, umi, four key columns)."""
    c = F.col
    s1 = c("l_orderkey") * 20 + c("l_partkey") % 97
    e1 = s1 + c("l_quantity").cast("bigint")
    s2 = e1 + 10 + c("l_suppkey") % 40
    e2 = s2 + c("l_linenumber") * 5
    umi = F.substr(F.md5(F.concat(c("l_partkey").cast("string"), F.lit("-"), c("l_suppkey").cast("string"))), F.lit(1), F.lit(2))
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("ref"), F.when(c("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.array(R.part(s1, e1), R.part(s2, e2)).alias("parts"), c("l_quantity").cast("bigint").alias("cnt"),
        (c("l_suppkey") % 3 + 1).alias("multiplicity"), (c("l_suppkey") % 4).alias("sample"), umi.alias("umi"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def first_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("parts", F.slice("parts", 1, 1))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-part annotations (gid, ref, strand, parts)."""
    c = F.col
    ref = F.when(c("p_partkey") % 3 == 0, "A").when(c("p_partkey") % 3 == 1, "N").otherwise("R")
    s = c("p_partkey") * 150
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("gid"), ref.alias("ref"), F.when(c("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.array(R.part(s, s + c("p_size") * 5)).alias("parts"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transcripts for each gene: all of it, and its ends without the middle."""
    g = genes(spark, sf_dir)
    s, e = R.start("parts"), R.end("parts")
    fifth = F.floor((e - s) / 5)
    cut = F.array(R.part(s, s + 2 * fifth), R.part(s + 3 * fifth, e))
    return g.select("gid", "ref", "strand", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("t"), F.col("parts").alias("parts")), F.struct(F.lit(1).cast("bigint").alias("t"), cut.alias("parts")))).alias("x")).select(
        "gid", "ref", "strand", (F.col("gid") * 2 + F.col("x.t")).alias("tid"), "x.parts"
    )


def numeric_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, strand, pos, value in hundredths) from the events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ref"), F.lit("+").alias("strand"), F.col("event_id").alias("pos"), F.round(F.col("value") * 100).cast("bigint").alias("value"), "user_id"
    )


READS = """reads AS (
  SELECT ref, strand, s1, e1, e1 + 10 + l_suppkey % 40 AS s2, e1 + 10 + l_suppkey % 40 + l_linenumber * 5 AS e2, cnt,
         l_suppkey % 3 + 1 AS multiplicity, l_suppkey % 4 AS sample, substr(md5(l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR), 1, 2) AS umi,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM (SELECT *, l_returnflag AS ref, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_quantity::BIGINT AS cnt,
               l_orderkey * 20 + l_partkey % 97 AS s1, l_orderkey * 20 + l_partkey % 97 + l_quantity::BIGINT AS e1 FROM lineitem))"""
GENES = """genes AS (
  SELECT p_partkey AS gid, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS ref,
         CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey * 150 AS gs, p_partkey * 150 + p_size * 5 AS ge FROM part)"""
TRANSCRIPTS = """tx AS (
  SELECT gid, ref, strand, gid * 2 AS tid, gs AS a1, ge AS b1, ge AS a2, ge AS b2 FROM genes
  UNION ALL
  SELECT gid, ref, strand, gid * 2 + 1, gs, gs + 2 * ((ge - gs) // 5), gs + 3 * ((ge - gs) // 5), ge FROM genes)"""
TRACK = """track AS (SELECT event_type AS ref, event_id AS pos, round(value * 100)::BIGINT AS value, user_id FROM events)"""
