"""Constrained reverse translation as Spark tables and expressions."""

from .operators.rules import DirectRepeats, ForbiddenMotifs, ForbiddenPaths, GC3Content, GCContent, Hairpins, InvertedRepeats, MaxHomopolymer, MutationDistance, Rule, TandemRepeats
from .operators.space import CodingSpace, MutationSpace, SpaceSpec
from .sources.genetic_code import TranslationTable
from .sources.sites import RestrictionSite
from .sources.usage import CodonWeights

__all__ = [
    "CodingSpace", "CodonWeights", "DirectRepeats", "ForbiddenMotifs", "ForbiddenPaths", "GC3Content", "GCContent", "Hairpins", "InvertedRepeats", "MaxHomopolymer",
    "MutationDistance", "MutationSpace", "RestrictionSite", "Rule", "SpaceSpec", "TandemRepeats", "TranslationTable",
]
