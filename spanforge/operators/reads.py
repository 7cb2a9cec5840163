"""Aligned reads with distinct sequences: filters, condition vectors, merging, mismatch features.

A row is (ref, strand, parts, distincts); ``distincts`` is an array of structs with a count per
condition, the multiplicity, and variations (type, pos, genomic, read, second).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counts as C
from . import joins

VARIATIONS = "array<struct<type:string,pos:int,genomic:string,read:string,second:boolean>>"
DISTINCTS = f"array<struct<counts:array<double>,multiplicity:int,vars:{VARIATIONS}>>"


def parse_range(text: str, n: int, names: list[str] | None = None) -> list[int]:
    """Indices of a range text: ``1,3:5``, ``-2:-1``, ``all``, or names."""
    if text.strip() == "all":
        return list(range(n))
    out = []
    for item in text.split(","):
        item = item.strip()
        if names and item in names:
            out.append(names.index(item))
            continue
        m = re.fullmatch(r"(-?\d+)(?::(-?\d+))?", item)
        if not m:
            raise ValueError(f"no such range: {item}")
        a = int(m.group(1))
        b = int(m.group(2)) if m.group(2) is not None else a
        a, b = (a + n if a < 0 else a), (b + n if b < 0 else b)
        out += range(a, b + 1)
    if any(not 0 <= i < n for i in out):
        raise ValueError(f"outside 0..{n - 1}: {text}")
    return out


def _edit_counts(distincts: Column, f) -> Column:
    return F.transform(distincts, lambda d: F.struct(f(d).alias("counts"), d["multiplicity"].alias("multiplicity"), d["vars"].alias("vars")))


def select_conditions(df: DataFrame, indices: list[int]) -> DataFrame:
    """Reads with these conditions only, in this order."""
    return df.withColumn("distincts", _edit_counts(F.col("distincts"), lambda d: F.array(*[F.get(d["counts"], F.lit(i)) for i in indices])))


def merge_conditions(df: DataFrame, groups: list[list[int]]) -> DataFrame:
    """Each new condition is the sum of some old ones."""
    add = lambda d, g: reduce(lambda a, b: a + b, [F.get(d["counts"], F.lit(i)) for i in g])
    return df.withColumn("distincts", _edit_counts(F.col("distincts"), lambda d: F.array(*[add(d, g) for g in groups])))


def unique_mapping(df: DataFrame, most: int = 1) -> DataFrame:
    """Without distinct sequences of a higher multiplicity, and rows that have none left."""
    kept = F.filter("distincts", lambda d: d["multiplicity"] <= most)
    return df.withColumn("distincts", kept).where(F.size("distincts") > 0)


def has_mismatches(df: DataFrame, genomic: str, read: str, least: int = 1) -> DataFrame:
    """Only distinct sequences with so many mismatches of a kind."""
    kept = F.filter("distincts", lambda d: F.size(F.filter(d["vars"], lambda v: (v["type"] == "M") & (v["genomic"] == genomic) & (v["read"] == read))) >= least)
    return df.withColumn("distincts", kept).where(F.size("distincts") > 0)


def condition_totals(distincts: Column, mode: str, n: int) -> Column:
    """Count vector over all distinct sequences of a row, in a count mode."""
    zero = F.array(*[F.lit(0.0)] * n)
    each = F.transform(distincts, lambda d: F.transform(d["counts"], lambda c: C.count(mode, c, d["multiplicity"]).cast("double")))
    return F.aggregate(each, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def merge_storages(frames: list[DataFrame], widths: list[int]) -> DataFrame:
    """Rows of equal region joined; equal distinct sequences become one, conditions stand side by side.

    ``widths`` are the numbers of conditions of the frames.
    """
    total = sum(widths)
    rows, before = [], 0
    for df, w in zip(frames, widths, strict=True):
        d = df.select("ref", "strand", "parts", F.explode("distincts").alias("d"))
        padded = F.concat(F.array_repeat(F.lit(0.0), before), F.col("d.counts"), F.array_repeat(F.lit(0.0), total - before - w))
        rows.append(d.select("ref", "strand", "parts", F.col("d.multiplicity").alias("multiplicity"), F.array_sort("d.vars").alias("vars"), padded.alias("c")))
        before += w
    each = reduce(lambda a, b: a.unionByName(b), rows)
    sums = each.groupBy("ref", "strand", "parts", "vars").agg(F.max("multiplicity").alias("multiplicity"), F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(total)]).alias("counts"))
    return sums.groupBy("ref", "strand", "parts").agg(F.array_sort(F.collect_list(F.struct("counts", "multiplicity", "vars"))).alias("distincts"))


def mismatch_count(distincts: Column) -> Column:
    """Mismatches of the first distinct sequence."""
    return F.size(F.filter(F.get(distincts, F.lit(0))["vars"], lambda v: v["type"] == "M")).cast("bigint")


def conversion_count(distincts: Column, genomic: str, read: str) -> Column:
    """Conversions of the first distinct sequence; second reads show the complement."""
    pairs = {"A": "T", "C": "G", "G": "C", "T": "A"}
    own = lambda v: ~F.coalesce(v["second"], F.lit(False)) & (v["genomic"] == genomic) & (v["read"] == read)
    other = lambda v: F.coalesce(v["second"], F.lit(False)) & (v["genomic"] == pairs[genomic]) & (v["read"] == pairs[read])
    return F.size(F.filter(F.get(distincts, F.lit(0))["vars"], lambda v: own(v) | other(v))).cast("bigint")


def leading_mismatches(distincts: Column) -> Column:
    """Mismatches at positions 0, 1, 2, ... without a gap."""
    at = F.array_sort(F.transform(F.filter(F.get(distincts, F.lit(0))["vars"], lambda v: v["type"] == "M"), lambda v: v["pos"]))
    return F.size(F.filter(at, lambda p, i: p == i)).cast("bigint")


def mismatch_strings(distincts: Column, what: str) -> Column:
    """Unfolded mismatch labels: Genomic, Read, Type, Position or TypePosition."""
    label = {
        "Genomic": lambda v: v["genomic"], "Read": lambda v: v["read"], "Type": lambda v: F.concat(v["genomic"], F.lit(">"), v["read"]),
        "Position": lambda v: v["pos"].cast("string"), "TypePosition": lambda v: F.concat(v["pos"].cast("string"), F.lit(":"), v["genomic"], F.lit(">"), v["read"]),
    }[what]
    return F.transform(F.filter(F.get(distincts, F.lit(0))["vars"], lambda v: v["type"] == "M"), label)


def multiplicity_label(multiplicity: Column) -> Column:
    return F.when(multiplicity <= 1, "unique").otherwise("ambiguous")


def rename_references(df: DataFrame, names: dict[str, str]) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn("ref", F.coalesce(F.try_element_at(mapping, F.col("ref")), F.col("ref")))


def restrict(df: DataFrame, where: DataFrame, mode: str = "any") -> DataFrame:
    """Rows that meet a set of regions."""
    return joins.overlap(df, where, "semi", mode)


def genes_of(transcripts: DataFrame, introns: bool = True) -> DataFrame:
    """Gene regions from transcripts: merged exons, or the whole span without introns."""
    from ..functions import region as R

    g = transcripts.groupBy("gene_id", "ref", "strand").agg(F.flatten(F.collect_list("parts")).alias("p"), F.min(F.when(F.col("coding_start") >= 0, F.col("coding_start"))).alias("coding_start"), F.max("coding_end").alias("coding_end"))
    parts = R.normalize("p")
    return g.select("gene_id", "ref", "strand", (parts if introns else R.remove_introns(parts)).alias("parts"), F.coalesce("coding_start", F.lit(-1)).alias("coding_start"), "coding_end")


def coding_parts(parts: Column, coding_start: Column, coding_end: Column) -> Column:
    """The coding part of a transcript; empty unless codingStart is positive."""
    from ..functions import region as R

    return F.when(coding_start > 0, R.intersect(parts, F.array(R.part(coding_start, coding_end)))).otherwise(R.empty())


def utr_parts(strand: Column, parts: Column, coding_start: Column, coding_end: Column, five: bool) -> Column:
    """The 5' or 3' untranslated part; empty for transcripts that don't code."""
    from ..functions import region as R

    left = R.intersect(parts, F.array(R.part(R.start(parts), coding_start)))
    right = R.intersect(parts, F.array(R.part(coding_end, R.end(parts))))
    first = (strand == "+") == F.lit(five)
    return F.when(coding_start > 0, F.when(first, left).otherwise(right)).otherwise(R.empty())
