"""Region algebra as Column expressions.

A region is an array of half-open parts ``struct<s:bigint,e:bigint>``, sorted and disjoint. All functions are pure and
stay inside the JVM. On strand ``-`` induced coordinates count from the right end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "array<struct<s:bigint,e:bigint>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(s: Column | int, e: Column | int) -> Column:
    lift = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return F.struct(lift(s).alias("s"), lift(e).alias("e"))


def empty() -> Column:
    return F.array().cast(PARTS)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def normalize(parts: Column | str) -> Column:
    """Sorted parts without empty ones; overlapping and touching parts become one."""

    def add(acc, p):
        last = F.get(acc, F.size(acc) - 1)
        apart = F.coalesce(last["e"] < p["s"], F.lit(True))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(part(last["s"], F.greatest(last["e"], p["e"]))))
        return F.when(apart, F.concat(acc, F.array(p))).otherwise(joined)

    kept = F.array_sort(F.filter(_col(parts).cast(PARTS), lambda p: p["s"] < p["e"]))
    return F.aggregate(kept, empty(), add)


def start(parts: Column | str) -> Column:
    return F.get(_col(parts), F.lit(0))["s"]


def end(parts: Column | str) -> Column:
    p = _col(parts)
    return F.get(p, F.size(p) - 1)["e"]


def stop(parts: Column | str) -> Column:
    """The last position inside."""
    return end(parts) - 1


def length(parts: Column | str) -> Column:
    return F.aggregate(_col(parts), F.lit(0).cast("bigint"), lambda a, p: a + p["e"] - p["s"])


def n_parts(parts: Column | str) -> Column:
    return F.size(_col(parts)).cast("bigint")


def is_empty(parts: Column | str) -> Column:
    return F.size(_col(parts)) == 0


def contains_position(parts: Column | str, pos: Column | int) -> Column:
    return F.exists(_col(parts), lambda p: (p["s"] <= pos) & (p["e"] > pos))


def contains(parts: Column | str, other: Column | str) -> Column:
    """Every part of ``other`` lies in one part."""
    return F.forall(_col(other), lambda q: F.exists(_col(parts), lambda p: (p["s"] <= q["s"]) & (q["e"] <= p["e"])))


def intersects(a: Column | str, b: Column | str) -> Column:
    """Any parts overlap; a region in an intron of the other doesn't."""
    return F.exists(_col(a), lambda p: F.exists(_col(b), lambda q: (p["s"] < q["e"]) & (q["s"] < p["e"])))


def introns(parts: Column | str) -> Column:
    """The gaps between parts."""
    p = _col(parts)
    inner = F.greatest(F.size(p) - 1, F.lit(0))
    return F.zip_with(F.slice(p, 1, inner), F.slice(p, 2, inner), lambda a, b: part(a["e"], b["s"]))


def invert_within(parts: Column | str, s: Column | int, e: Column | int) -> Column:
    """The complement inside [s, e)."""
    p = _col(parts)
    edges = F.concat(F.array(part(s, s)), p, F.array(part(e, e)))
    gaps = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: part(F.greatest(a["e"], F.lit(s) if isinstance(s, int) else s), F.least(b["s"], F.lit(e) if isinstance(e, int) else e)))
    return F.filter(gaps, lambda g: g["s"] < g["e"])


def intron_consistent(a: Column | str, b: Column | str) -> Column:
    """Neither region has parts in the other's introns."""
    return ~intersects(introns(a), b) & ~intersects(introns(b), a)


def contains_unspliced(parts: Column | str, other: Column | str) -> Column:
    return contains(parts, other) & intron_consistent(parts, other)


def intersect(a: Column | str, b: Column | str) -> Column:
    pairs = F.flatten(F.transform(_col(a), lambda p: F.transform(_col(b), lambda q: part(F.greatest(p["s"], q["s"]), F.least(p["e"], q["e"])))))
    return F.array_sort(F.filter(pairs, lambda p: p["s"] < p["e"]))


def intersect_length(a: Column | str, b: Column | str) -> Column:
    """Positions that both have, without building their region."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(_col(a), zero, lambda n, p: F.aggregate(_col(b), n, lambda m, q: m + F.greatest(zero, F.least(p["e"], q["e"]) - F.greatest(p["s"], q["s"]))))


def union(a: Column | str, b: Column | str) -> Column:
    return normalize(F.concat(_col(a), _col(b)))


def subtract(a: Column | str, b: Column | str) -> Column:
    """The positions of ``a`` that ``b`` doesn't have."""
    lo, hi = F.least(start(a), start(b)), F.greatest(end(a), end(b))
    rest = intersect(a, invert_within(b, lo, hi))
    return F.when(is_empty(a) | is_empty(b), _col(a)).otherwise(rest)


def coverage(a: Column | str, b: Column | str) -> Column:
    """The share of ``a`` that ``b`` covers."""
    return intersect_length(a, b) / length(a)


def remove_introns(parts: Column | str) -> Column:
    return F.when(is_empty(parts), empty()).otherwise(F.array(part(start(parts), end(parts))))


def translate(parts: Column | str, by: Column | int) -> Column:
    return F.transform(_col(parts), lambda p: part(p["s"] + by, p["e"] + by))


def scale(parts: Column | str, factor: int) -> Column:
    """Peptide to nucleotide coordinates with 3."""
    return F.transform(_col(parts), lambda p: part(p["s"] * factor, p["e"] * factor))


def unscale(parts: Column | str, divisor: int) -> Column:
    """Nucleotide to peptide coordinates with 3, by integer division."""
    return F.transform(_col(parts), lambda p: part(F.floor(p["s"] / divisor), F.floor(p["e"] / divisor)))


def reverse(parts: Column | str, total: Column | int) -> Column:
    """The mirror image in [0, total)."""
    return F.reverse(F.transform(_col(parts), lambda p: part(total - p["e"], total - p["s"])))


def with_offsets(parts: Column | str) -> Column:
    """Parts with their first induced coordinate: struct<s,e,o>."""

    def add(acc, p):
        last = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.struct(p["s"].alias("s"), p["e"].alias("e"), F.coalesce(last["o"] + last["e"] - last["s"], F.lit(0).cast("bigint")).alias("o"))))

    return F.aggregate(_col(parts), F.array().cast("array<struct<s:bigint,e:bigint,o:bigint>>"), add)


def map_position(parts: Column | str, p: Column | int) -> Column:
    """Induced to genomic coordinate; null outside."""
    found = F.filter(with_offsets(parts), lambda x: (x["o"] <= p) & (x["o"] + x["e"] - x["s"] > p))
    return let(F.get(found, F.lit(0)), lambda x: x["s"] + p - x["o"])


def induce_position(parts: Column | str, p: Column | int) -> Column:
    """Genomic to induced coordinate; null outside."""
    found = F.filter(with_offsets(parts), lambda x: (x["s"] <= p) & (x["e"] > p))
    return let(F.get(found, F.lit(0)), lambda x: x["o"] + p - x["s"])


def map_region(parts: Column | str, induced: Column | str) -> Column:
    """An induced region in genomic coordinates; what lies outside is cut off."""
    pairs = F.flatten(F.transform(with_offsets(parts), lambda x: F.transform(_col(induced), lambda q: part(
        x["s"] + F.greatest(q["s"] - x["o"], F.lit(0)), x["s"] + F.least(q["e"] - x["o"], x["e"] - x["s"])))))
    return normalize(pairs)


def induce_region(parts: Column | str, other: Column | str) -> Column:
    """A genomic region, cut to the parts, in induced coordinates."""
    pairs = F.flatten(F.transform(with_offsets(parts), lambda x: F.transform(_col(other), lambda q: part(
        x["o"] + F.greatest(q["s"] - x["s"], F.lit(0)), x["o"] + F.least(q["e"], x["e"]) - x["s"]))))
    return normalize(pairs)


def stranded(strand: Column | str, parts: Column | str, p: Column) -> Column:
    """An induced coordinate read from the region's 5' end."""
    return F.when(_col(strand) == "-", length(parts) - 1 - p).otherwise(p)


def map_stranded(strand: Column | str, parts: Column | str, p: Column | int) -> Column:
    lifted = F.lit(p).cast("bigint") if isinstance(p, int) else p
    return map_position(parts, stranded(strand, parts, lifted))


def induce_stranded(strand: Column | str, parts: Column | str, p: Column | int) -> Column:
    return stranded(strand, parts, induce_position(parts, p))


def extend(parts: Column | str, front: Column | int, back: Column | int) -> Column:
    """Longer by so many positions at the left and right; negative numbers cut along induced coordinates."""
    f = F.lit(front).cast("bigint") if isinstance(front, int) else front.cast("bigint")
    b = F.lit(back).cast("bigint") if isinstance(back, int) else back.cast("bigint")
    zero = F.lit(0).cast("bigint")
    p = _col(parts)
    cut = map_region(p, F.array(part(F.greatest(-f, zero), length(p) - F.greatest(-b, zero)))) if _may_cut(front) or _may_cut(back) else p

    def grow(c):
        longer = F.concat(F.array(part(start(c) - F.greatest(f, zero), start(c))), c, F.array(part(end(c), end(c) + F.greatest(b, zero))))
        return F.when(is_empty(c), c).otherwise(normalize(longer))

    return let(cut, grow)


def _may_cut(by: Column | int) -> bool:
    return not isinstance(by, int) or by < 0


def distance(a: Column | str, b: Column | str) -> Column:
    """Positions between the bounding intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), start(a) - end(b), start(b) - end(a))


def five_prime(strand: Column | str, parts: Column | str) -> Column:
    return F.when(_col(strand) == "-", stop(parts)).otherwise(start(parts))


def three_prime(strand: Column | str, parts: Column | str) -> Column:
    return F.when(_col(strand) == "-", start(parts)).otherwise(stop(parts))


def center(parts: Column | str) -> Column:
    return map_position(parts, F.floor(length(parts) / 2))


POSITIONS = ("Start", "Stop", "End", "FivePrime", "ThreePrime", "Center")


def position(kind: str, strand: Column | str, parts: Column | str, offset: int = 0) -> Column:
    """A named position; the offset goes in the strand's direction for the primes, else to the right."""
    sign = F.when(_col(strand) == "-", F.lit(-offset)).otherwise(F.lit(offset))
    return {
        "Start": lambda: start(parts) + offset, "Stop": lambda: stop(parts) + offset, "End": lambda: end(parts) + offset,
        "FivePrime": lambda: five_prime(strand, parts) + sign, "ThreePrime": lambda: three_prime(strand, parts) + sign,
        "Center": lambda: center(parts) + offset,
    }[kind]()


def flank(strand: Column | str, parts: Column | str, upstream: int, downstream: int) -> Column:
    """The interval around the 5' end."""
    p = five_prime(strand, parts)
    minus = _col(strand) == "-"
    return F.array(part(F.when(minus, p - downstream).otherwise(p - upstream), F.when(minus, p + upstream).otherwise(p + downstream) + 1))


def to_text(parts: Column | str) -> Column:
    """``s1-e1|s2-e2``."""
    return F.array_join(F.transform(_col(parts), lambda p: F.concat_ws("-", p["s"], p["e"])), "|")


def parse(text: Column | str) -> Column:
    """The reverse of :func:`to_text`; commas in numbers are allowed, a single number is one position."""
    clean = F.split(F.regexp_replace(_col(text), ",", ""), "\\|")

    def one(x):
        b = F.split(x, "-")
        s = b[0].cast("bigint")
        return part(s, F.coalesce(F.get(b, F.lit(1)).cast("bigint"), s + 1))

    return F.when(F.length(_col(text)) == 0, empty()).otherwise(F.transform(clean, one))


def extract_sequence(parts: Column | str, sequence: Column | str) -> Column:
    """The bases of a 0-based sequence at the region."""
    return F.array_join(F.transform(_col(parts), lambda p: F.substr(_col(sequence), (p["s"] + 1).cast("int"), (p["e"] - p["s"]).cast("int"))), "")


def opposite(strand: Column | str) -> Column:
    s = _col(strand)
    return F.when(s == "+", "-").when(s == "-", "+").otherwise("")


def trim_reference(name: Column | str) -> Column:
    """Without ``chr``; ``M`` is ``MT``."""
    t = F.regexp_replace(_col(name), "^chr", "")
    return F.when(t == "M", "MT").otherwise(t)


def ucsc_reference(name: Column | str) -> Column:
    t = trim_reference(name)
    return F.concat(F.lit("chr"), F.when(t == "MT", "M").otherwise(t))


def location(ref: Column | str, strand: Column | str, parts: Column | str) -> Column:
    return F.concat(_col(ref), _col(strand), F.lit(":"), to_text(parts))


def location_order(ref: Column | str, strand: Column | str, parts: Column | str) -> list[Column]:
    """Sort keys: numeric names by value before others, then strand, bounds and parts."""
    t = trim_reference(ref)
    number = F.when(t.rlike("^[0-9]{1,18}$"), t.cast("bigint"))
    rank = F.when(_col(strand) == "+", 0).when(_col(strand) == "-", 1).otherwise(2)
    return [number.isNull().asc(), number.asc(), t.asc(), rank.asc(), start(parts).asc_nulls_first(), end(parts).asc_nulls_first(), _col(parts).asc()]
