"""Recognition sites of common restriction enzymes."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession

_PAIRS = str.maketrans("ACGTacgt", "TGCAtgca")


def reverse_complement(seq: str) -> str:
    return seq.translate(_PAIRS)[::-1]


class RestrictionSite(Enum):
    # Recognition sites as listed by New England Biolabs.
    EcoRI = "GAATTC"
    XbaI = "TCTAGA"
    SpeI = "ACTAGT"
    PstI = "CTGCAG"
    BamHI = "GGATCC"
    HindIII = "AAGCTT"
    XhoI = "CTCGAG"
    SalI = "GTCGAC"
    KpnI = "GGTACC"
    SacI = "GAGCTC"
    NcoI = "CCATGG"
    NdeI = "CATATG"
    NotI = "GCGGCCGC"
    MluI = "ACGCGT"
    AgeI = "ACCGGT"
    AvrII = "CCTAGG"
    BglII = "AGATCT"
    BsaI = "GGTCTC"
    BsmBI = "CGTCTC"
    BbsI = "GAAGAC"
    SapI = "GCTCTTC"

    forward = property(lambda self: self.value)
    reverse = property(lambda self: reverse_complement(self.value))
    motifs = property(lambda self: tuple(dict.fromkeys((self.forward, self.reverse))))

    def __str__(self) -> str:
        return f"RestrictionSite.{self.name}"

    def __repr__(self) -> str:
        return f"RestrictionSite.{self.name} ({' / '.join(self.motifs)})"


def sites_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.forward, s.reverse, list(s.motifs)) for s in RestrictionSite], "name string, forward string, reverse string, motifs array<string>")
