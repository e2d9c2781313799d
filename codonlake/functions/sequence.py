"""Scalar functions of sequences as Spark columns: no Python on the executors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.genetic_code import TranslationTable


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(seq, rna: bool = False) -> Column:
    """Upper case, no spaces, T and U as the molecule has them; null where a letter is not a nucleotide."""
    s = F.replace(F.upper(_col(seq)), F.lit(" "), F.lit(""))
    s = F.translate(s, "T", "U") if rna else F.translate(s, "U", "T")
    return F.when(s.rlike(r"\A[ACGU]*\z" if rna else r"\A[ACGT]*\z"), s)


def normalise_strict(seq, rna: bool = False) -> Column:
    """As normalise, but an invalid sequence is an error."""
    s = normalise(seq, rna)
    return F.when(_col(seq).isNull() | s.isNotNull(), s).otherwise(F.raise_error(F.lit("Invalid sequence")))


def _code(table: TranslationTable) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.codons_to_aa.items() for x in pair])


def codons(cds) -> Column:
    c = _col(cds)
    n = F.floor(F.length(c) / 3).cast("int")
    return F.when(n < 1, F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * 3 + 1, F.lit(3))))


def translate(cds, table: TranslationTable | None = None) -> Column:
    """The protein of a normalised coding sequence; null if its length is no multiple of three or a codon is unknown."""
    code = _code(table or TranslationTable())
    aa = F.transform(codons(cds), lambda c: F.try_element_at(code, c))
    return F.when((F.length(_col(cds)) % 3 == 0) & ~F.exists(aa, lambda a: a.isNull()), F.array_join(aa, ""))


def codon_lookup(codon, table: TranslationTable | None = None) -> Column:
    table = table or TranslationTable()
    return F.try_element_at(_code(table), normalise(codon, table.rna))


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def _dna(seq) -> Column:
    return F.translate(F.upper(_col(seq)), "U", "T")


def contains_any(seq, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(_col(seq), F.lit(w))
    return out


def has_homopolymer(seq, longer_than: int) -> Column:
    return contains_any(seq, [c * (longer_than + 1) for c in "ACGTU"])


def has_tandem(seq, unit: int, copies: int = 2) -> Column:
    return F.regexp_like(_col(seq), F.lit(f"([ACGTU]{{{unit}}})\\1{{{copies - 1}}}"))


def has_direct_repeat(seq, length: int, min_distance: int = 0, max_distance: int | None = None) -> Column:
    """Some `length` letters occur again at the distance: one expression that refers back to what it has met."""
    most = "" if max_distance is None else max_distance
    return F.regexp_like(_dna(seq), F.lit(f"(?s)(.{{{length}}}).{{{min_distance},{most}}}?\\1"))


def has_inverted_repeat(seq, length: int, min_distance: int = 0, max_distance: int | None = None) -> Column:
    return _repeat(_dna(seq), length, min_distance, max_distance, reverse_complement)


def has_hairpin(seq, stem: int, min_loop: int = 0, max_loop: int | None = None) -> Column:
    return has_inverted_repeat(seq, stem, min_loop, max_loop)


def _repeat(s: Column, length: int, lo: int, hi: int | None, partner) -> Column:
    starts = F.sequence(F.lit(1), F.length(s) - F.lit(2 * length + lo - 1))

    def found(i):
        from_ = i + F.lit(length + lo)
        rest = F.substring(s, from_, F.length(s)) if hi is None else F.substring(s, from_, F.lit(hi - lo + length))
        return F.contains(rest, partner(F.substring(s, i, F.lit(length))))

    return F.when(F.length(s) < 2 * length + lo, F.lit(False)).otherwise(F.exists(starts, found))


def nt_distance(a, b) -> Column:
    """Places at which two strings of one length differ; null for different lengths."""
    x, y = _col(a), _col(b)
    d = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), lambda z: z))
    return F.when(F.length(x) == F.length(y), d)


def codon_distance(a, b) -> Column:
    x, y = _col(a), _col(b)
    d = F.size(F.filter(F.zip_with(codons(x), codons(y), lambda p, q: p != q), lambda z: z))
    return F.when(F.length(x) == F.length(y), d)


def gc_count(cds) -> Column:
    c = _col(cds)
    return F.length(c) - F.length(F.translate(c, "GC", ""))


def gc3_count(cds) -> Column:
    return F.size(F.filter(codons(cds), lambda c: F.substring(c, 3, 1).isin("G", "C")))


def nt_mask(letters) -> Column:
    """A=1, C=2, G=4, T=U=8, or-ed over the letters of a string."""
    bits = F.create_map(*[F.lit(x) for x in ("A", 1, "C", 2, "G", 4, "T", 8, "U", 8)])
    return F.aggregate(F.split(F.upper(_col(letters)), ""), F.lit(0), lambda acc, c: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, c), F.lit(0))))


def choice_masks(choices) -> Column:
    """For an array of strings of one length, the mask of each place."""
    c = _col(choices)
    return F.transform(F.sequence(F.lit(1), F.length(F.element_at(c, 1))), lambda i: nt_mask(F.array_join(F.transform(c, lambda w: F.substring(w, i, F.lit(1))), "")))


def format_count(n) -> Column:
    """A count given as a whole number or a string of digits: 1,234 below 10^9, else 3.91 × 10^657."""
    s = _col(n).cast("string")
    digits = F.length(s)
    small = F.format_number(F.when(digits < 10, s).cast("long"), 0)
    # up to 10^22 powers of ten are doubles, so the quotient is the one that SQL has
    exact = digits <= 22
    head = F.when(exact, s).otherwise(F.substring(s, 1, 17)).cast("double") / F.pow(F.lit(10.0), F.when(exact, digits - 1).otherwise(16))
    # a double from 1 to 10 has 52 binary places at most: hundredths, and what is left of them in 2^50ths
    parts = (head * F.lit(float(2**52))).cast("long") * 25
    hundredths, rest, half = F.shiftright(parts, 50), parts.bitwiseAND(F.lit(2**50 - 1)), F.lit(2**49)
    rounded = hundredths + F.when((rest > half) | ((rest == half) & (hundredths % 2 == 1)), 1).otherwise(0)
    shown = F.concat(F.floor(rounded / 100).cast("string"), F.lit("."), F.lpad((rounded % 100).cast("string"), 2, "0"))
    text = F.regexp_replace(shown, "[.]?0+$", "")
    return F.when(digits < 10, small).otherwise(F.concat(text, F.lit(" × 10^"), (digits - 1).cast("string")))
