"""Location strings: ``1+:100-200|300-400;2:5-9``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ref string, strand string, parts array<struct<s:bigint,e:bigint>>"
WHOLE = 1 << 40


def parse_location(text: str) -> tuple[str, str, list[tuple[int, int]]]:
    """(ref, strand, parts); without a colon the whole reference, a single number is one position."""
    name, _, where = text.strip().partition(":")
    m = re.fullmatch(r"(.*?)([+-]?)", name)
    ref, strand = m.group(1).removeprefix("chr"), m.group(2)
    if not where:
        return ref, strand, [(0, WHOLE)]
    parts = []
    for x in where.replace(",", "").split("|"):
        s, _, e = x.partition("-")
        parts.append((int(s), int(e) if e else int(s) + 1))
    return ref, strand, parts


def parse_locations(spark: SparkSession, text: str) -> DataFrame:
    """Locations separated by ``;`` as rows (ref, strand, parts)."""
    return spark.createDataFrame([parse_location(x) for x in text.split(";") if x.strip()], SCHEMA)
