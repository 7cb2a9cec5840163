"""Feature programs: named extractors over one scan, and statistics grouped by their value sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Statistic:
    keys: list[str]
    counts: dict[str, Column]
    unfold: list[str] = field(default_factory=list)
    min_fraction: float = 0.0


class Program:
    """Extractors give a sorted set of strings per row; later ones can use earlier ones."""

    def __init__(self) -> None:
        self.features: list[tuple[str, Column, Column | None]] = []
        self.gates: list[tuple[int, Column]] = []

    def add(self, name: str, values: Column, condition: Column | str | None = None) -> Program:
        """A feature of a scalar or array column; where the condition fails its set is empty."""
        self.features.append((name, values, F.expr(condition) if isinstance(condition, str) else condition))
        return self

    def gate(self, predicate: Column | str) -> Program:
        """Rows that fail are dropped before later features."""
        self.gates.append((len(self.features), F.expr(predicate) if isinstance(predicate, str) else predicate))
        return self

    def extract(self, df: DataFrame) -> DataFrame:
        for i, (name, values, condition) in enumerate(self.features):
            for at, gate in self.gates:
                if at == i:
                    df = df.where(gate)
            as_set = F.array_sort(F.array_distinct(F.array_compact(values.cast("array<string>"))))
            none = F.array().cast("array<string>")
            cell = F.coalesce(as_set, none) if condition is None else F.when(condition, F.coalesce(as_set, none)).otherwise(none)
            df = df.withColumn(name, cell)
        for at, gate in self.gates:
            if at >= len(self.features):
                df = df.where(gate)
        return df

    def statistic(self, df: DataFrame, s: Statistic) -> DataFrame:
        """Sums per tuple of value sets. Unfolded keys count a row for each value; tuples below
        ``min_fraction`` of the first count's total go into one row of the key ``other``."""
        rows = self.extract(df)
        for k in s.unfold:
            rows = rows.withColumn(k, F.explode(F.transform(k, lambda x: F.array(x))))
        keys = [F.array_join(k, ",").alias(k) for k in s.keys]
        out = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in s.counts.items()])
        if s.min_fraction:
            first = next(iter(s.counts))
            total = out.agg(F.sum(first)).first()[0] or 0
            rare = F.col(first) < s.min_fraction * total
            out = out.groupBy(*[F.when(rare, "other").otherwise(F.col(k)).alias(k) for k in s.keys]).agg(*[F.sum(n).alias(n) for n in s.counts])
        return out


def second_stage(statistic: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """A statistic grouped again by fewer keys."""
    return statistic.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def rules(cases: list[tuple[Column, str]], default: str | None, all_rules: bool = False) -> Column:
    """The first rule that holds, or all that do, as an array."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))
    fallback = F.array(F.lit(default)) if default is not None else F.array().cast("array<string>")
    found = names if all_rules else F.slice(names, 1, 1)
    return F.when(F.size(names) > 0, found).otherwise(fallback)


# The three classes of a position or read.
EXONIC, INTRONIC, INTERGENIC = "Exonic", "Intronic", "Intergenic"


def exon_intron_class(exonic: Column, genic: Column) -> Column:
    return F.when(exonic, EXONIC).when(genic, INTRONIC).otherwise(INTERGENIC)


def absolute_position(p: Column, length: Column, upstream: int, downstream: int) -> Column:
    """A position relative to an annotation of some length, capped: -upstream-1 and length+downstream are the overflow bins."""
    return F.greatest(F.lit(-upstream - 1), F.least(p, length + downstream)).cast("bigint")


def frame(p: Column) -> Column:
    return F.pmod(p, F.lit(3)).cast("bigint")


def relative_bin(p: Column, length: Column, bins: int) -> Column:
    return F.floor(p * bins / length)


CHAINS = ("None", "FirstForEach", "FirstForAny")


def map_values(values: Column, cases: list[tuple[str, object, str | None]], chain: str = "None", default: str | None = None) -> Column:
    """Labels of a set of values by rules (kind, pattern, label): ``regex``, ``contains``, ``equals``, or ``table`` with a dictionary as
    pattern. All rules count (chain ``None``), the first that fits each value, or the first that fits any. The default stands where nothing fits."""

    def fits(kind: str, pattern, label):
        if kind == "table":
            table = F.create_map(*[F.lit(x) for pair in pattern.items() for x in pair])
            return lambda v: F.try_element_at(table, v)
        test = {"regex": lambda v: v.rlike(f"^(?:{pattern})$"), "contains": lambda v: F.contains(v, F.lit(pattern)), "equals": lambda v: v == pattern}[kind]
        return lambda v: F.when(test(v), F.lit(label))

    found = [fits(*c) for c in cases]
    sets = [F.array_compact(F.transform(values, f)) for f in found]
    if chain == "FirstForEach":
        labels = F.array_compact(F.transform(values, lambda v: F.coalesce(*[f(v) for f in found])))
    elif chain == "FirstForAny":
        labels = F.coalesce(*[F.when(F.size(s) > 0, s) for s in sets], F.array().cast("array<string>"))
    elif chain == "None":
        labels = F.flatten(F.array(*sets))
    else:
        raise ValueError(f"no such chain: {chain}")
    labels = F.array_sort(F.array_distinct(labels))
    return labels if default is None else F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(default)))


def sequence_between(parts: Column, sequence: Column, start: Column | int, stop: Column | int) -> Column:
    """Bases of a region's induced positions start .. stop-1, introns left out; null outside."""
    from ..functions import region as R

    bases = R.extract_sequence(parts, sequence)
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.when((a >= 0) & (b <= F.length(bases)) & (a < b), F.substr(bases, (a + 1).cast("int"), (b - a).cast("int")))
