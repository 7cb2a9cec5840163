"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations only.

In every window of consecutive word k-grams the one with the lowest hash is kept. Two texts that
share ``span`` words share the window's k-grams and so its lowest: documents without a fingerprint of
the benchmark hold none of its windows. Hits are extended in the others: each of their windows is
held, as words, against the benchmark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _native as N
from . import _scratch

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
GRAM = 5


def words_of(text: Column) -> Column:
    return N.split_words(N.ascii_lower(text), SEPARATORS)


def fingerprints(words: str, span: int, gram: int) -> Column:
    """Winnowed fingerprints of an array of words; none of fewer than ``span`` words."""
    hashes = N.window_hashes(words, gram)
    width = span - gram + 1
    # the transform over one element names the hashes, so that they are computed once
    return F.transform(F.array(hashes), lambda h: F.transform(N.indices(F.size(h) - (width - 1)), lambda i: F.array_min(F.slice(h, i + 1, width))))[0]


def windows(words: str, n: int) -> Column:
    """All windows of n words as (at, n, win)."""
    w = F.col(words)
    return F.transform(N.indices(F.size(w) - (n - 1)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("win")))


def _keyed(docs: DataFrame, text_col: str, *also: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*also, text.alias("body"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_hit, n_items, item_ids array<string>, contaminated).

    A window is ``span`` consecutive words of an item, or all words of a shorter one. ``n_hit``
    counts the words inside any occurrence of a window. Null and blank texts have no words and match
    nothing; a null item id is not listed; equal texts are searched once and all their rows get the
    result; ids may repeat or be null; other columns are ignored.
    """
    bench = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where("size(w) > 0")
    bench = _scratch.stored(bench, "items")
    sizes = [r[0] for r in bench.select(F.least(F.size("w"), F.lit(span)).alias("n")).distinct().collect()]  # ``span`` numbers at most
    none = F.array().cast("array<long>")
    short = sorted(n for n in sizes if n < span)

    def marks(own_length_only: bool) -> Column:
        one = [F.when(F.size("w") == n, N.window_hashes("w", n)).otherwise(none) if own_length_only else N.window_hashes("w", n) for n in short]
        return F.explode(F.array_distinct(F.concat(fingerprints("w", span, gram), *one)))

    known = _scratch.stored(bench.select(marks(True).alias("f")).distinct(), "fingerprints")
    texts = _keyed(docs, text_col)
    found = texts.select("k1", "k2", words_of(F.col("body")).alias("w")).select("k1", "k2", marks(False).alias("f"))
    found = found.join(N.small(known, known.count()), "f", "left_semi").select("k1", "k2").distinct()
    found = _scratch.stored(found, "candidates")

    # extend the hits: every window of a candidate, as words
    pairs = bench.select("item", F.explode(_own_windows(sizes or [span], span)).alias("x"))
    pairs = _scratch.stored(pairs.select("item", "x.win").distinct(), "windows")
    # windows with the items that have them: a document meets a window once, however many items share it
    holders = _scratch.stored(pairs.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")), "holders")
    n_wins, n_bytes = holders.agg(F.count("*"), F.sum(F.octet_length("win") + F.octet_length(F.array_join("items", ",")))).first()
    wins = holders.select("win")
    bodies = texts.join(N.small(found, found.count()), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    bodies = bodies.select("k1", "k2", words_of(F.col("body")).alias("w"))
    every = bodies.select("k1", "k2", F.explode(F.concat(*[windows("w", n) for n in sizes or [span]])).alias("x")).select("k1", "k2", "x.*")
    hits = _scratch.stored(every.join(N.small(wins, n_wins, n_bytes), "win", "left_semi"), "hits")
    spans = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("stop")))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["to"], s["at"]))).alias("n"), F.greatest(a["to"], s["stop"]).alias("to")))
    spans = spans.select("k1", "k2", covered["n"].alias("n_hit"))
    named = hits.select("k1", "k2", "win").distinct().join(N.small(holders, n_wins, n_bytes), "win").groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    named = named.withColumn("n_items", F.size("item_ids"))
    result = _scratch.stored(spans.join(named, ["k1", "k2"], "left"), "hit-texts")
    rows = _keyed(docs, text_col, F.col(id_col).alias("doc_id"))
    rows = rows.select("doc_id", "k1", "k2", F.size(words_of(F.col("body"))).cast("long").alias("n_words"))
    out = rows.join(N.small(result, result.count()), ["k1", "k2"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _own_windows(sizes: list[int], span: int) -> Column:
    """Windows of an item: of ``span`` words, or of all its words if fewer."""
    empty = F.expr("cast(array() as array<struct<at:int,n:int,win:string>>)")
    return F.concat(*[F.when(F.least(F.size("w"), F.lit(span)) == n, windows("w", n)).otherwise(empty) for n in sizes])


def digest(found: DataFrame) -> DataFrame:
    """The item ids as one hash."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
