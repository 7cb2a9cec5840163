"""Readers and writers of interval and table text formats.

Files are read by Spark, so every path and compression that Spark knows works. Reference names lose
``chr``; coordinates are 0-based and half open.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import region as R
from . import locations
from .sam import read_sam

#: Separators that inference tries, in this order.
SEPARATORS = "\t;, |#&"


def _fields(spark: SparkSession, path: str, comments: tuple[str, ...] = ("#", "track", "browser")) -> DataFrame:
    lines = spark.read.text(path)
    skip = F.lit(False)
    for c in comments:
        skip = skip | F.col("value").startswith(c)
    return lines.where(~skip & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def _strand(c: Column) -> Column:
    return F.when(c.isin("+", "-"), c).otherwise("")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED with 3 to 12 columns: (ref, strand, parts, name, score, thick_start, thick_end); blocks are parts."""
    s, e = _f(1).cast("bigint"), _f(2).cast("bigint")
    sizes = F.filter(F.split(_f(10), ","), lambda x: x != "")
    starts = F.filter(F.split(_f(11), ","), lambda x: x != "")
    blocks = F.zip_with(starts, sizes, lambda a, b: R.part(s + a.cast("bigint"), s + a.cast("bigint") + b.cast("bigint")))
    parts = F.when(F.size("f") >= 12, R.normalize(blocks)).otherwise(F.array(R.part(s, e)))
    return _fields(spark, path).select(
        R.trim_reference(_f(0)).alias("ref"), F.coalesce(_strand(_f(5)), F.lit("")).alias("strand"), parts.alias("parts"),
        _f(3).alias("name"), _f(4).try_cast("double").alias("score"), _f(6).try_cast("bigint").alias("thick_start"), _f(7).try_cast("bigint").alias("thick_end"),
    )


def write_bed(df: DataFrame, path: str, name: Column | None = None, score: Column | None = None) -> None:
    """BED12 lines of (ref, strand, parts)."""
    s, e = R.start("parts"), R.end("parts")
    sizes = F.array_join(F.transform("parts", lambda p: (p["e"] - p["s"]).cast("string")), ",")
    starts = F.array_join(F.transform("parts", lambda p: (p["s"] - s).cast("string")), ",")
    fields = [F.col("ref"), s, e, name if name is not None else F.lit("."), score if score is not None else F.lit(0), F.when(F.col("strand") == "", ".").otherwise(F.col("strand")), s, s, F.lit(0), F.size("parts"), sizes, starts]
    df.select(F.concat_ws("\t", *[f.cast("string") for f in fields])).write.text(path)


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(
        R.trim_reference(_f(0)).alias("ref"), _strand(_f(5)).alias("strand"), F.array(R.part(_f(1).cast("bigint"), _f(2).cast("bigint"))).alias("parts"), _f(3).alias("name"),
        *[_f(i).cast("double").alias(n) for i, n in ((4, "score"), (6, "signal"), (7, "p"), (8, "q"))], _f(9).cast("bigint").alias("summit"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 features with their attributes as a map."""
    pairs = F.filter(F.split(_f(8), ";"), lambda x: F.contains(x, F.lit("=")))
    attributes = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))), F.split_part(x, F.lit("="), F.lit(2)))))
    return _fields(spark, path).select(
        R.trim_reference(_f(0)).alias("ref"), _strand(_f(6)).alias("strand"), F.array(R.part(_f(3).cast("bigint") - 1, _f(4).cast("bigint"))).alias("parts"),
        _f(1).alias("source"), _f(2).alias("type"), _f(5).try_cast("double").alias("score"), attributes.alias("attributes"),
    )


def read_gtf(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """Transcripts (ref, strand, parts, gene_id, transcript_id, coding_start, coding_end) of a GTF file.

    Intervals of all lines of a transcript, or of those of the given types, are merged. Coding bounds
    are those of CDS and codon lines, -1 without any.
    """
    attribute = lambda n: F.nullif(F.regexp_extract(_f(8), n + ' "([^"]*)"', 1), F.lit(""))
    rows = _fields(spark, path).select(
        R.trim_reference(_f(0)).alias("ref"), _strand(_f(6)).alias("strand"), _f(2).alias("type"), (_f(3).cast("bigint") - 1).alias("s"), _f(4).cast("bigint").alias("e"),
        attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"),
    ).where("transcript_id is not null")
    used = F.col("type").isin(types) if types else F.lit(True)
    coding = F.col("type").isin("CDS", "start_codon", "stop_codon")
    g = rows.groupBy("gene_id", "transcript_id", "ref", "strand").agg(
        F.collect_list(F.when(used, R.part(F.col("s"), F.col("e")))).alias("p"),
        F.coalesce(F.min(F.when(coding, F.col("s"))), F.lit(-1)).alias("coding_start"), F.coalesce(F.max(F.when(coding, F.col("e"))), F.lit(-1)).alias("coding_end"),
    )
    return g.select("ref", "strand", R.normalize("p").alias("parts"), "gene_id", "transcript_id", "coding_start", "coding_end").where("size(parts) > 0")


def write_gtf(df: DataFrame, path: str, source: str = "spanforge") -> None:
    """Exon lines of (ref, strand, parts, gene_id, transcript_id)."""
    attributes = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('";'))
    rows = df.select("*", F.explode("parts").alias("p"))
    fields = [F.col("ref"), F.lit(source), F.lit("exon"), F.col("p.s") + 1, F.col("p.e"), F.lit("."), F.when(F.col("strand") == "", ".").otherwise(F.col("strand")), F.lit("."), attributes]
    rows.select(F.concat_ws("\t", *[f.cast("string") for f in fields])).write.text(path)


def write_bedgraph(df: DataFrame, path: str) -> None:
    """Runs (ref, s, e, depth) as bedGraph lines."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("ref", "s", "e", "depth")])).write.text(path)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """A location in the first column of each line: (ref, strand, parts, rest)."""
    loc = F.split_part(F.col("value"), F.lit("\t"), F.lit(1))
    name = F.split_part(loc, F.lit(":"), F.lit(1))
    return spark.read.text(path).where("trim(value) <> ''").select(
        R.trim_reference(F.regexp_extract(name, "^(.*?)[+-]?$", 1)).alias("ref"), F.regexp_extract(name, "([+-]?)$", 1).alias("strand"),
        R.parse(F.split_part(loc, F.lit(":"), F.lit(2))).alias("parts"), F.nullif(F.expr("substr(value, length(split_part(value, '\t', 1)) + 2)"), F.lit("")).alias("rest"),
    )


def write_locations(df: DataFrame, path: str) -> None:
    df.select(R.location("ref", "strand", "parts")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence) of each entry."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.split_part(F.col("value"), F.lit("\n"), F.lit(1))
    return rows.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("name"), head.alias("description"), F.regexp_replace(F.expr("substr(value, instr(value, '\n') + 1)"), "[\r\n ]", "").alias("sequence"))


def sequence_chunks(fasta: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Sequences cut into (name, chunk, bases) for range access."""
    n = F.ceil(F.length("sequence") / size).cast("int")
    return fasta.select("name", "sequence", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("chunk")).select("name", "chunk", F.substr("sequence", F.col("chunk") * size + 1, F.lit(size)).alias("bases"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, quality); entries of exactly four lines, counted in file order."""
    from ..operators import tracks

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = tracks.numbered(lines, ["file", "block", "line"], None, "rn")
    nth = lambda i: F.max(F.when(F.col("rn") % 4 == i, F.col("value")))
    entries = rows.groupBy(F.floor(F.col("rn") / 4).alias("entry")).agg(nth(0).alias("name"), nth(1).alias("sequence"), nth(3).alias("quality"))
    return entries.select(F.regexp_replace("name", "^@", "").alias("name"), "sequence", "quality")


def sniff(lines: list[str]) -> tuple[str, bool, list[str]]:
    """(separator, header?, types) of delimited lines: the first separator with the same number of
    fields, at least two, on all lines; types boolean, int, bigint, double or string."""
    rows = [x for x in lines if x and not x.startswith("#")]

    def split(x: str, sep: str) -> list[str]:
        return [f[1:-1] if len(f) > 1 and f[0] == f[-1] == '"' else f for f in re.split(re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', x)]

    sep = next((s for s in SEPARATORS if rows and len(n := {len(split(x, s)) for x in rows}) == 1 and n.pop() > 1), "\t")
    cells = [split(x, sep) for x in rows]

    def kind(values: list[str]) -> str:
        if values and all(v.lower() in ("true", "false") for v in values):
            return "boolean"
        if values and all(re.fullmatch(r"-?\d+", v) for v in values):
            return "int" if all(-(2**31) <= int(v) < 2**31 for v in values) else "bigint"
        if values and all(re.fullmatch(r"-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|NaN|-?Infinity", v) for v in values):
            return "double"
        return "string"

    body = [kind(list(c)) for c in zip(*cells[1:], strict=True)] if len(cells) > 1 else []
    first = [kind([c]) for c in cells[0]] if cells else []
    header = bool(cells) and all(k == "string" for k in first) and (len(set(cells[0])) == len(cells[0])) and (not body or any(k != "string" for k in body))
    types = body if header and body else [kind(list(c)) for c in zip(*cells, strict=True)]
    return sep, header, types


def _schema(lines: list[str]) -> tuple[str, bool, T.StructType]:
    sep, header, types = sniff(lines)
    rows = [x for x in lines if x and not x.startswith("#")]
    names = [n.strip('"') for n in rows[0].split(sep)] if header else [f"c{i}" for i in range(len(types))]
    return sep, header, T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))


def read_csv(spark: SparkSession, path: str, sniffed: int = 1000) -> DataFrame:
    """A delimited file; separator, header and types come from its first lines."""
    sep, header, schema = _schema([r[0] for r in spark.read.text(path).limit(sniffed).collect()])
    return spark.read.csv(path, sep=sep, header=header, schema=schema, comment="#")


def read_csv_lines(spark: SparkSession, lines: DataFrame, first: list[str]) -> DataFrame:
    """Like read_csv, of a frame of lines whose first ones are given."""
    sep, header, schema = _schema(first)
    rows = lines
    if header:  # the header is one line; lines equal to it further on are data
        same = lines.where(F.col("value") == first[0]).withColumn("_id", F.monotonically_increasing_id())
        again = same.withColumn("_n", F.row_number().over(Window.partitionBy("value").orderBy("_id"))).where("_n > 1")
        rows = lines.select("value").where(~F.col("value").eqNullSafe(first[0])).union(again.select("value"))
    return rows.select(F.from_csv("value", F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"sep": sep}).alias("r")).select("r.*")


def _lists(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("bigint"))


def read_exons(spark: SparkSession, path: str, ref: str, strand: str, starts: str, ends: str, one_based: bool = False, sep: str = "\t") -> DataFrame:
    """A table whose rows are transcripts with lists of exon starts and ends in two columns: (ref, strand, parts) and its other columns."""
    rows = spark.read.csv(path, sep=sep, header=True)
    parts = F.zip_with(_lists(F.col(starts)), _lists(F.col(ends)), lambda a, b: R.part(a - int(one_based), b))
    rest = [c for c in rows.columns if c not in (ref, strand, starts, ends)]
    return rows.select(R.trim_reference(F.col(ref)).alias("ref"), _strand(F.col(strand)).alias("strand"), R.normalize(parts).alias("parts"), *rest)


def write_genepred(df: DataFrame, path: str, name: Column) -> None:
    """Lines of transcripts (ref, strand, parts, coding_start, coding_end) with lists of exon bounds."""
    listed = lambda f: F.concat(F.array_join(F.transform("parts", lambda p: p[f].cast("string")), ","), F.lit(","))
    coding = lambda c, other: F.when(F.col("coding_start") >= 0, F.col(c)).otherwise(other)
    fields = [name, F.col("ref"), F.col("strand"), R.start("parts"), R.end("parts"), coding("coding_start", R.end("parts")), coding("coding_end", R.end("parts")), F.size("parts"), listed("s"), listed("e")]
    df.select(F.concat_ws("\t", *[f.cast("string") for f in fields])).write.text(path)


def write_position_graphs(df: DataFrame, folder: str, conditions: dict[str, Column]) -> None:
    """For each condition a bedGraph of counts at the 5' ends per strand, below ``folder/name/plus`` and ``minus``."""
    at = df.groupBy("ref", "strand", R.five_prime("strand", "parts").alias("pos")).agg(*[F.sum(c).alias(n) for n, c in conditions.items()])
    for name in conditions:
        for strand, label in (("+", "plus"), ("-", "minus")):
            rows = at.where((F.col("strand") == strand) & (F.col(name) != 0)).orderBy("ref", "pos")
            write_bedgraph(rows.select("ref", (F.col("pos") + 1).alias("s"), (F.col("pos") + 2).alias("e"), F.col(name).alias("depth")), f"{folder}/{name}/{label}")


def write_frame(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header)


def write_flat_table(df: DataFrame, path: str, row: str, columns: list[str]) -> None:
    """The entries of a matrix that aren't zero, as (row, column, value)."""
    write_frame(df.unpivot(row, columns, "column", "value").where("value <> 0"), path)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Features (accession, type, strand, parts) of GenBank files; join and complement positions."""
    rows = spark.read.option("lineSep", "\n//").text(path).where("value like '%FEATURES%'")
    accession = F.regexp_extract("value", r"ACCESSION\s+(\S+)", 1)
    body = F.regexp_extract("value", r"(?s)FEATURES[^\n]*\n(.*?)(?:\nORIGIN|\z)", 1)
    joined = F.regexp_replace(F.regexp_replace(body, r"\n {21}(?=[0-9,<>])", ""), r"\n {21}/[^\n]*", "")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^ {5}\S"))
    f = rows.select(accession.alias("accession"), F.explode(lines).alias("line")).select("accession", F.regexp_extract("line", r"^ {5}(\S+)", 1).alias("type"), F.regexp_extract("line", r"^ {5}\S+\s+(\S+)", 1).alias("at"))
    spans = F.regexp_extract_all("at", F.lit(r"(<?\d+(?:\.\.>?\d+)?)"))

    def one(x):
        a = F.regexp_extract(x, r"(\d+)", 1).cast("bigint")
        b = F.regexp_extract(x, r"\.\.>?(\d+)", 1).try_cast("bigint")
        return R.part(a - 1, F.coalesce(b, a))

    return f.select("accession", "type", F.when(F.contains("at", F.lit("complement")), "-").otherwise("+").alias("strand"), R.normalize(F.transform(spans, one)).alias("parts"))


#: Readers by file name ending.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bed": read_bed, "narrowPeak": read_narrowpeak, "gff": read_gff, "gff3": read_gff, "gtf": read_gtf, "locations": read_locations,
    "sam": read_sam, "fasta": read_fasta, "fa": read_fasta, "fastq": read_fastq, "gb": read_genbank, "csv": read_csv, "tsv": read_csv,
    "parquet": lambda s, p: s.read.parquet(p), "json": lambda s, p: s.read.json(p), "orc": lambda s, p: s.read.orc(p), "txt": lambda s, p: s.read.text(p),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a file by its ending; .gz and .bz2 are passed over."""
    name = re.sub(r"\.(gz|bz2)$", "", path.rstrip("/"))
    ending = name.rsplit(".", 1)[-1]
    if ending not in READERS:
        raise ValueError(f"no reader for {path}")
    return READERS[ending](spark, path)


def files(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """Paths and sizes of files, without their content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(pattern).select("path", "length", "modificationTime")


def write_regions(df: DataFrame, path: str) -> None:
    """Rows (ref, strand, parts, ...) partitioned by reference and strand and sorted by position, so
    that a scan of an interval reads few row groups."""
    out = df.withColumns({"s": R.start("parts"), "e": R.end("parts")})
    out.repartition("ref", "strand", F.floor(F.col("s") / (1 << 24))).sortWithinPartitions("ref", "strand", "s", "e").write.partitionBy("ref", "strand").parquet(path)


def scan_regions(spark: SparkSession, path: str, location: str) -> DataFrame:
    """Rows that intersect a location; reference, strand and bounds are pushed to the files."""
    ref, strand, parts = locations.parse_location(location)
    rows = spark.read.parquet(path).where((F.col("ref") == ref) & (F.col("s") < parts[-1][1]) & (F.col("e") > parts[0][0]))
    rows = rows.where(F.col("strand") == strand) if strand else rows
    return rows.where(R.intersects("parts", F.array(*[R.part(a, b) for a, b in parts])))
