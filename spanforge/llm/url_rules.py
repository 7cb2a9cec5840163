"""URL filters: pattern rules behind an index of their rarest literal tokens.

A rule is a regular expression on ``host + path`` with the literal tokens that any match must
contain. It is filed under the one of them that the fewest URLs hold. A URL's tokens fetch the rules
that can match, and only those are run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules a filter may have; they are sent to every task.
MOST_RULES = 200_000
TOKEN = "[a-z0-9]+"


class Rule(NamedTuple):
    """``name`` is what a match reports; of matching rules the one of the highest rank wins, the first
    of equals. Rules without tokens run on every URL."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host and its subdomains, where the path starts with ``path``; longer rules win.

    Whole tokens of the path are literal; its last token may go on in a URL, unless a separator follows.
    """
    sure = re.sub("[a-z0-9]+$", "", path.lower())
    tokens = (*re.findall(TOKEN, host.lower()), *re.findall(TOKEN, sure))
    return Rule(f"{host}{path}", verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, len(host) + len(path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Index:
    """Rules by their rarest literal token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        for i, rule in enumerate(rules):
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def best(self, host: str, path: str) -> Rule | None:
        target, found = host + path, None
        candidates = set(self.always)
        for token in set(re.findall(TOKEN, target.lower())):
            candidates.update(self.by_token.get(token, ()))
        for i in candidates:
            rule = self.rules[i]
            if found is not None and (-rule.rank, i) > found:
                continue
            if i not in self.compiled:
                self.compiled[i] = re.compile(rule.pattern, re.DOTALL)
            if self.compiled[i].match(target):
                found = (-rule.rank, i)
        return None if found is None else self.rules[found[1]]


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: (page_id, host, path, rule, verdict).

    ``rule`` is the winning rule's name, null where none matches or it has none; ``verdict`` is then ``default``. A null url
    or one without ``://`` has an empty host and path. Ids may repeat or be null; other columns are
    ignored.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    literals = sorted({t for r in rules for t in r.tokens})
    spark = pages.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in literals], "token string"))  # as many as rules have
    tokens = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})")))).alias("token"))
    frequency = {r["token"]: r["n"] for r in tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()} if literals else {}
    index = Index(rules, frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.best(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.name if r else None for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(pages.dtypes)[id_col]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The rules of the registered query.
QUERY_RULES = [
    host_rule("com", "/en/", "block"), host_rule("example.com", "/en/7", "allow"), host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"), host_rule("org", "/es/", "block"),
]
