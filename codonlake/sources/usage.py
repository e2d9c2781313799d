"""Codon usage weights: presets, uniform, thresholds, restriction; as dimension tables."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .genetic_code import TranslationTable

# Codon counts of the public GenScript codon frequency tables (column "Number").
COUNTS = {
    "ecoli": """
        F TTT 80995 TTC 58774
        L TTA 52382 TTG 47500 CTT 43449 CTC 37347 CTA 15409 CTG 177210
        Y TAT 63937 TAC 44631
        * TAA 7356 TAG 989 TGA 3623
        H CAT 45879 CAC 34078
        Q CAA 53394 CAG 104171
        I ATT 109072 ATC 86796 ATA 24984
        M ATG 96695
        N AAT 75436 AAC 78443
        K AAA 129137 AAG 45459
        V GTT 72584 GTC 52439 GTA 42420 GTG 89265
        D GAT 119939 GAC 70394
        E GAA 143353 GAG 68609
        S TCT 38027 TCC 33430 TCA 32715 TCG 31146 AGT 36097 AGC 55551
        C TGT 19138 TGC 22188
        W TGG 50991
        P CCT 27340 CCC 19666 CCA 31534 CCG 76644
        R CGT 73197 CGC 72212 CGA 13844 CGG 21552 AGA 13152 AGG 7607
        T ACT 37842 ACC 80547 ACA 33910 ACG 50269
        A GCT 62479 GCC 88721 GCA 77547 GCG 110308
        G GGT 93325 GGC 99390 GGA 34799 GGG 41277
    """,
    "yeast": """
        F TTT 147662 TTC 103110
        L TTA 149466 TTG 153307 CTT 68959 CTC 30501 CTA 75775 CTG 59027
        Y TAT 106420 TAC 83100
        * TAA 5596 TAG 2681 TGA 3516
        H CAT 77724 CAC 44082
        Q CAA 155751 CAG 68932
        I ATT 171272 ATC 96735 ATA 100930
        M ATG 118274
        N AAT 204015 AAC 141103
        K AAA 239186 AAG 174250
        V GTT 124665 GTC 65664 GTA 66649 GTG 60286
        D GAT 214363 GAC 114918
        E GAA 260082 GAG 108411
        S TCT 133502 TCC 80612 TCA 106266 TCG 48524 AGT 80293 AGC 54825
        C TGT 45222 TGC 26520
        W TGG 58416
        P CCT 77061 CCC 38414 CCA 103062 CCG 29916
        R CGT 36693 CGC 14645 CGA 17111 CGG 9872 AGA 120587 AGG 52322
        T ACT 114746 ACC 71204 ACA 100680 ACG 44995
        A GCT 119402 GCC 71065 GCA 91502 GCG 34754
        G GGT 135417 GGC 54977 GGA 61825 GGG 33885
    """,
    "human": """
        F TTT 336562 TTC 406571
        L TTA 143715 TTG 249879 CTT 253795 CTC 386182 CTA 138154 CTG 800774
        Y TAT 239268 TAC 310695
        * TAA 14322 TAG 10915 TGA 25383
        H CAT 207826 CAC 297048
        Q CAA 234785 CAG 688316
        I ATT 313225 ATC 426570 ATA 140652
        M ATG 443795
        N AAT 331714 AAC 387148
        K AAA 476554 AAG 654280
        V GTT 216818 GTC 290874 GTA 139156 GTG 575438
        D GAT 443369 GAC 517579
        E GAA 577846 GAG 810842
        S TCT 291040 TCC 346943 TCA 233110 TCG 89429 AGT 237404 AGC 385113
        C TGT 197293 TGC 243685
        W TGG 255512
        P CCT 343793 CCC 397790 CCA 331944 CCG 139414
        R CGT 93458 CGC 217130 CGA 126113 CGG 235938 AGA 228151 AGG 227281
        T ACT 255582 ACC 382050 ACA 294223 ACG 123533
        A GCT 370873 GCC 567930 GCA 317338 GCG 150708
        G GGT 215544 GGC 453917 GGA 325243 GGG 326879
    """,

}
#: Where tables of further organisms are read from: a folder of files <organism>.txt with lines as above.
USAGE_DIR = "CODONLAKE_USAGE_DIR"

def counts_of(organism: str, folder: str | None = None) -> dict[str, dict[str, float]]:
    """Counts of an organism: built in, or from <folder>/<organism>.txt (default: the folder named by CODONLAKE_USAGE_DIR)."""
    text = COUNTS.get(organism)
    if text is None:
        path = os.path.join(folder or os.environ.get(USAGE_DIR, ""), f"{organism}.txt")
        if not os.path.exists(path):
            raise ValueError(f"No codon counts for {organism!r}: put {organism}.txt into a folder and name it in {USAGE_DIR}.")
        with open(path, encoding="utf-8") as f:
            text = f.read()
    rows = [line.split() for line in text.strip().splitlines() if line.strip()]
    return {r[0]: {c: float(n) for c, n in zip(r[1::2], r[2::2])} for r in rows}

class CodonWeights:
    """Immutable weights of codons, normalised to 1 for each amino acid."""

    __slots__ = ("_by_aa", "_flat")

    def __init__(self, weights: Mapping[str, Mapping[str, float]]):
        by_aa: dict[str, dict[str, float]] = {}
        seen: set[str] = set()
        for aa, codons in weights.items():
            key = aa.upper()
            if key in by_aa:
                raise ValueError(f"Duplicate amino acid {aa!r}.")
            own: dict[str, float] = {}
            for codon, w in codons.items():
                c = codon.upper()
                if c in seen:
                    raise ValueError(f"Duplicate codon {codon!r}.")
                seen.add(c)
                if not math.isfinite(w) or w < 0:
                    raise ValueError(f"Weight of codon {codon!r} must be a non-negative number.")
                own[c] = float(w)
            total = sum(own.values())
            if total <= 0:
                raise ValueError(f"Weights of amino acid {aa!r} must have a positive sum.")
            by_aa[key] = {c: w / total for c, w in own.items()}
        object.__setattr__(self, "_by_aa", {a: MappingProxyType(w) for a, w in by_aa.items()})
        object.__setattr__(self, "_flat", {c: w for d in by_aa.values() for c, w in d.items()})

    def __setattr__(self, key, value):
        raise AttributeError("CodonWeights is immutable.")

    def __reduce__(self):
        return CodonWeights, ({a: dict(w) for a, w in self._by_aa.items()},)

    def __copy__(self):
        return self

    def __deepcopy__(self, memo):
        return self

    def __getitem__(self, codon: str) -> float:
        return self._flat[codon]

    def __iter__(self):
        return iter(self._flat)

    def __len__(self):
        return len(self._flat)

    def __contains__(self, codon) -> bool:
        return codon in self._flat

    def __eq__(self, other):
        return isinstance(other, CodonWeights) and self._flat == other._flat

    def __hash__(self):
        return hash(tuple(sorted(self._flat.items())))

    def __repr__(self) -> str:
        return "CodonWeights\n" + "\n".join(f"    {a}: " + ", ".join(f"{c} {w:.3f}" for c, w in self._by_aa[a].items()) for a in sorted(self._by_aa))

    def items(self):
        return self._flat.items()

    def by_aa(self, aa: str) -> Mapping[str, float]:
        return self._by_aa[aa.upper()]

    @property
    def amino_acids(self) -> tuple[str, ...]:
        return tuple(self._by_aa)

    def for_table(self, table: TranslationTable) -> CodonWeights:
        """The same weights in the table's molecule; residues and codons must be exactly those of the table."""
        own = {a: {table.normalise_sequence(c): w for c, w in d.items()} for a, d in self._by_aa.items()}
        if missing := sorted(set(table.aa_to_codons) - set(own)):
            raise ValueError(f"Weights lack amino acids: {', '.join(missing)}.")
        if extra := sorted(set(own) - set(table.aa_to_codons)):
            raise ValueError(f"Weights have amino acids that the table lacks: {', '.join(extra)}.")
        for aa, codons in table.aa_to_codons.items():
            if missing := sorted(set(codons) - set(own[aa])):
                raise ValueError(f"Weights of {aa!r} lack codons: {', '.join(missing)}.")
            if extra := sorted(set(own[aa]) - set(codons)):
                raise ValueError(f"Weights of {aa!r} have codons that the table lacks: {', '.join(extra)}.")
        return self if all(own[a].keys() == self._by_aa[a].keys() for a in own) else CodonWeights(own)

    def threshold(self, min_weight: float) -> CodonWeights:
        """Weights under min_weight become 0, the rest is normalised again."""
        if isinstance(min_weight, bool) or not 0 <= min_weight <= 1:
            raise ValueError("min_weight must be between 0 and 1.")
        new = {a: {c: (0.0 if w < min_weight else w) for c, w in d.items()} for a, d in self._by_aa.items()}
        if all(new[a] == dict(self._by_aa[a]) for a in new):
            return self
        for a, d in new.items():
            if not sum(d.values()):
                raise ValueError(f"No codon of amino acid {a!r} reaches {min_weight}.")
        return CodonWeights(new)

    def restrict(self, table: TranslationTable) -> tuple[TranslationTable, CodonWeights]:
        """Table and weights without the codons of weight 0."""
        own = self.for_table(table)
        gone = sorted(c for c, w in own.items() if w == 0)
        if not gone:
            return table, own
        note = ", ".join(gone) if len(gone) <= 6 else f"{len(gone)} codons"
        small = TranslationTable.custom({c: a for c, a in table.codons_to_aa.items() if c not in set(gone)}, f"{table.name} without {note}", table.rna)
        return small, CodonWeights({a: {c: w for c, w in d.items() if w > 0} for a, d in own._by_aa.items()})

    @classmethod
    def uniform(cls, table: TranslationTable | None = None) -> CodonWeights:
        table = table or TranslationTable()
        return cls({a: dict.fromkeys(c, 1.0) for a, c in table.aa_to_codons.items()})

    @classmethod
    def organism(cls, name: str, folder: str | None = None) -> CodonWeights:
        return cls(counts_of(name, folder))

    ecoli = classmethod(lambda cls: cls.organism("ecoli"))
    yeast = classmethod(lambda cls: cls.organism("yeast"))
    human = classmethod(lambda cls: cls.organism("human"))
    mouse = classmethod(lambda cls: cls.organism("mouse"))
    arabidopsis = classmethod(lambda cls: cls.organism("arabidopsis"))
    drosophila = classmethod(lambda cls: cls.organism("drosophila"))

def normalised(raw: DataFrame) -> DataFrame:
    """organism, aa, codon, raw -> weight as the share of the amino acid's sum."""
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("organism", "aa")))

def thresholded(weights: DataFrame, least: float) -> DataFrame:
    """organism, aa, codon, weight with weights under `least` set to 0 and normalised again."""
    kept = weights.withColumn("raw", F.when(F.col("weight") < least, F.lit(0.0)).otherwise(F.col("weight"))).drop("weight")
    return normalised(kept).drop("raw")

def usage_frame(spark: SparkSession, organisms=tuple(COUNTS)) -> DataFrame:
    """organism, aa, codon, raw, weight."""
    rows = [(o, a, c, float(n)) for o in organisms for a, d in counts_of(o).items() for c, n in d.items()]
    return normalised(spark.createDataFrame(rows, "organism string, aa string, codon string, raw double"))
