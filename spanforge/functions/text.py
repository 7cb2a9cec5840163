"""String and sequence functions as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# IUPAC ambiguity codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def translate_codons(seq: Column) -> Column:
    """Amino acids of a coding sequence: an incomplete tail is dropped, unknown codons are X."""
    code = {"".join(c): a for c, a in zip(product(BASES, repeat=3), AMINO_ACIDS, strict=True)}
    table = F.create_map(*[F.lit(x) for pair in code.items() for x in pair])
    n = F.floor(F.length(seq) / 3).cast("int")
    codons = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(seq, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def is_orf(seq: Column) -> Column:
    """Starts with ATG, ends at its first stop codon."""
    amino = translate_codons(seq)
    return (F.length(seq) % 3 == 0) & amino.startswith("M") & (F.instr(amino, "*") == F.length(amino))


def gc_content(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GCgc", ""))) / F.length(seq)


def poly_a_tail(seq: Column) -> Column:
    return F.length(F.regexp_extract(seq, "(A*)$", 1)).cast("bigint")


def iupac_pattern(motif: str) -> str:
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def kmers(seq: Column, k: int) -> Column:
    """All overlapping substrings of length k."""
    n = F.length(seq) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_entropy(seq: Column, k: int) -> Column:
    """Shannon entropy in bits of the k-mers."""
    all_kmers = F.array_sort(kmers(seq, k))
    n = F.size(all_kmers)
    runs = F.transform(F.array_distinct(all_kmers), lambda x: F.size(F.filter(all_kmers, lambda y: x == y)) / n)
    return -F.aggregate(runs, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def hamming(a: Column, b: Column) -> Column:
    """Differing places; of unequal lengths the longer length."""
    places = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0).cast("bigint"), lambda acc, i: acc + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("bigint"))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b)).cast("bigint")).otherwise(places)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(acc))).otherwise(0).cast("bigint")


def count_char(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, char, ""))).cast("bigint")


def split_field(text: Column, separator: str, index: int) -> Column:
    return F.split_part(text, F.lit(separator), F.lit(index + 1))


def is_int(text: Column) -> Column:
    return text.rlike("^-?[0-9]+$")


def is_numeric(text: Column) -> Column:
    return text.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$")


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, "^(-?[0-9]+)", 1).try_cast("bigint")


def trailing_number(text: Column) -> Column:
    return F.regexp_extract(text, "([0-9]+)$", 1).try_cast("bigint")


def pad_left(text: Column, n: int, char: str = " ") -> Column:
    return F.lpad(text, n, char)


def camel_case(text: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(text, "[_ ]+", " ")), " ", "")


def masked_quotes(text: Column, separator: str) -> Column:
    """Separators inside double quotes replaced by a placeholder."""
    return F.regexp_replace(text, f'{separator}(?=[^"]*"[^"]*(?:"[^"]*"[^"]*)*$)', "\x01")


def scramble(text: Column, seed: int) -> Column:
    """The letters in another order."""
    return F.array_join(F.shuffle(F.split(text, ""), seed), "")
