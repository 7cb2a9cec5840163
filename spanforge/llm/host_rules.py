"""Quality rules with host-level verdicts, in DataFrame operations only.

Rules fail or pass each document. Per host and rule the failures are counted, and the rate is shrunk
with a beta prior fitted to all hosts by moments. A host is rejected where its shrunk rate of any rule is above
``max_rate`` and stands out among the hosts, by OUTLIER standard deviations of the prior above its mean (CERTAIN at most); its
verdict joins back to its documents, good ones included. A document that fails a rule itself goes whatever its host.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _native as N
from . import _scratch

SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Failures a host may have, as a shrunk rate: most of its documents.
MAX_RATE = 0.5
#: Standard deviations of the fitted prior that a rejected host lies above its mean, or this rate, if that is less.
OUTLIER, CERTAIN = 3, 0.75
#: Documents that the prior counts for at least, so that a host of a few isn't rejected.
LEAST_STRENGTH = 10
#: What a document may have: symbols a word, repeated lines of all its lines with a word, characters a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_CHARS = 0.1, 0.5, (3, 10)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of a text column.

    Null, empty and blank texts count nothing. The text column and work columns are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    df = docs.withColumns({"_words": N.split_words(text, SPACE), "_lines": lines, "_text": text})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", _SPACES, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": N.window_hashes("_words", 3),
    })
    # windows found twice stand together once sorted; texts without one skip the sort
    placed = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), placed))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_sorted", j)["h"], F.lit(False))
    again = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    gaps = F.zip_with(F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, x: acc + x)
    df = df.withColumn("n_repeat_words", F.when(F.size("_at") > 0, covered).otherwise(F.lit(0).cast("long")))
    return df.drop("_words", "_lines", "_text", "_grams", "_sorted", "_at", text_col)


def prior(hosts: DataFrame, failed: str, total: str) -> tuple[float, float]:
    """Alpha and beta of a beta prior for the hosts' failure rates, by moments.

    Without any document, or without spread beyond chance, the prior is as strong as it gets (10^6).
    """
    f, n = F.col(failed), F.col(total)
    row = hosts.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.count("*").alias("h"), F.sum(f * f / n).alias("ff")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = row["f"] / row["n"]
    spread = row["ff"] / row["n"] - mean * mean - mean * (1 - mean) * row["h"] / row["n"]
    strength = 1e6 if spread <= 0 else min(1e6, max(LEAST_STRENGTH, mean * (1 - mean) / spread - 1))
    return mean * strength + 1e-9, (1 - mean) * strength + 1e-9


def host_verdicts(docs: DataFrame, host_col: str, rules: dict[str, Column], max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with ``host_kept``: false on each row of a host that fails a rule too often.

    ``rules`` name boolean columns that are true where a document fails; null counts as passed. Null
    is a host of its own. An empty table stays empty.
    """
    hosts = docs.groupBy(F.col(host_col).alias("_host")).agg(F.count("*").alias("_n"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"_f_{r}") for r, c in rules.items()])
    hosts = _scratch.stored(hosts, "hosts")
    bad = F.lit(False)
    for r in rules:
        alpha, beta = prior(hosts, f"_f_{r}", "_n")
        mean = alpha / (alpha + beta)
        most = max(max_rate, min(CERTAIN, mean + OUTLIER * math.sqrt(mean * (1 - mean) / (alpha + beta + 1))))
        bad = bad | ((F.col(f"_f_{r}") + alpha) / (F.col("_n") + alpha + beta) > most)
    verdict = hosts.where(bad).select("_host", F.lit(False).alias("_kept"))
    rows, n_bytes = verdict.agg(F.count("*"), F.sum(F.octet_length(F.col("_host").cast("string")))).first()
    joined = docs.join(N.small(verdict, rows, n_bytes), docs[host_col].eqNullSafe(verdict["_host"]), "left")
    return joined.withColumn("host_kept", F.coalesce("_kept", F.lit(True))).drop("_host", "_kept")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows.
    ``kept``: not failed, no rule on symbols, repeated lines or word lengths failed, and the host not rejected. Null
    text has no words and fails; a null host is a host; ids may repeat or be null; other columns are ignored. An
    empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("_source"), F.col(text_col).alias("_body"))
    n = F.col("n_words")
    counted = text_counts(rows, "_body").select(
        "*", (n < 50).alias("short"), (100 * F.col("n_repeat_words") > 50 * n).alias("repeats"), (F.col("n_symbols") > MAX_SYMBOLS * n).alias("symbols"),
        (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines")).alias("lines"), ((F.col("word_chars") < WORD_CHARS[0] * n) | (F.col("word_chars") > WORD_CHARS[1] * n)).alias("letters"),
    )
    failed = F.col("short") | F.col("repeats")
    counted = _scratch.stored(counted.withColumn("any", failed | F.col("symbols") | F.col("lines") | F.col("letters")), "counts")
    judged = host_verdicts(counted, "_source", {r: F.col(r) for r in ("short", "repeats", "symbols", "lines", "letters", "any")}, max_rate)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~F.col("any") & F.col("host_kept")).alias("kept"))
