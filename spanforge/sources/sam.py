"""SAM text: alignments as reads with their parts, mismatches and multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import region as R

REVERSE, UNMAPPED, SECOND = 0x10, 0x4, 0x80
_OPS = r"(\d+)([MIDNSHP=X])"


def cigar_parts(start: Column, cigar: Column) -> Column:
    """The aligned region: M, =, X and D go on with a part, N opens the next one."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _OPS, 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = F.struct(start.cast("bigint").alias("at"), R.empty().alias("parts"))

    def step(a, x):
        moved = a["at"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["n"]).otherwise(0)
        grown = F.when(x["op"].isin("M", "=", "X", "D"), F.concat(a["parts"], F.array(R.part(a["at"], a["at"] + x["n"])))).otherwise(a["parts"])
        return F.struct(moved.alias("at"), grown.alias("parts"))

    return R.normalize(F.aggregate(ops, zero, step)["parts"])


def aligned_bases(cigar: Column, sequence: Column) -> Column:
    """The read's bases at M, = and X."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _OPS, 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("bases"))

    def step(a, x):
        read = x["op"].isin("M", "=", "X", "I", "S")
        taken = F.when(x["op"].isin("M", "=", "X"), F.concat(a["bases"], F.substr(sequence, a["at"], x["n"]))).otherwise(a["bases"])
        return F.struct((a["at"] + F.when(read, x["n"]).otherwise(0)).alias("at"), taken.alias("bases"))

    return F.aggregate(ops, zero, step)["bases"]


def mismatches(md: Column, bases: Column, second: Column) -> Column:
    """Variations of type M by an MD text: the place among the aligned bases, the genomic and the read's base."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    entry = "array<struct<type:string,pos:int,genomic:string,read:string,second:boolean>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(entry).alias("v"))

    def step(a, x):
        here = F.struct(F.lit("M").alias("type"), a["at"].alias("pos"), x.alias("genomic"), F.substr(bases, a["at"] + 1, F.lit(1)).alias("read"), second.alias("second"))
        base = x.rlike("^[A-Z]$")
        moved = F.when(base, a["at"] + 1).when(x.rlike("^[0-9]"), a["at"] + F.coalesce(x.try_cast("int"), F.lit(0))).otherwise(a["at"])
        return F.struct(moved.alias("at"), F.when(base, F.concat(a["v"], F.array(here))).otherwise(a["v"]).alias("v"))

    return F.coalesce(F.aggregate(tokens, zero, step)["v"], F.array().cast(entry))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped alignments (ref, strand, parts, name, flag, quality, distincts): a read as one distinct sequence of count 1
    with its multiplicity (NH, or 1) and mismatches (MD). Header lines and unmapped reads are passed over."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    tag = lambda name: F.get(F.transform(F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda x: x.startswith(name)), lambda x: F.substr(x, F.lit(6))), F.lit(0))
    rows = rows.select(
        at(0).alias("name"), at(1).cast("int").alias("flag"), R.trim_reference(at(2)).alias("ref"), (at(3).cast("bigint") - 1).alias("_s"), at(4).cast("int").alias("quality"),
        at(5).alias("_cigar"), at(9).alias("_seq"), tag("NH:").try_cast("int").alias("_nh"), tag("MD:").alias("_md"),
    ).where((F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("_cigar") != "*"))
    second = F.col("flag").bitwiseAND(SECOND) != 0
    one = F.struct(F.array(F.lit(1.0)).alias("counts"), F.coalesce("_nh", F.lit(1)).alias("multiplicity"), mismatches(F.col("_md"), aligned_bases(F.col("_cigar"), F.col("_seq")), second).alias("vars"))
    strand = F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+")
    return rows.select("ref", strand.alias("strand"), cigar_parts(F.col("_s"), F.col("_cigar")).alias("parts"), "name", "flag", "quality", F.array(one).alias("distincts"))


def write_sam(df: DataFrame, path: str, name: Column, multiplicity: Column | None = None) -> None:
    """Alignment lines of (ref, strand, parts), without sequences."""
    gaps = F.transform("parts", lambda p, i: F.concat(F.when(i > 0, F.concat((p["s"] - F.get("parts", i - 1)["e"]).cast("string"), F.lit("N"))).otherwise(""), (p["e"] - p["s"]).cast("string"), F.lit("M")))
    flag = F.when(F.col("strand") == "-", REVERSE).otherwise(0)
    fields = [name, flag, F.col("ref"), R.start("parts") + 1, F.lit(255), F.array_join(gaps, ""), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*")]
    fields += [F.concat(F.lit("NH:i:"), multiplicity.cast("string"))] if multiplicity is not None else []
    df.select(F.concat_ws("\t", *[x.cast("string") for x in fields])).write.text(path)
