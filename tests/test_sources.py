import copy
import pickle

import pytest

from codonlake import CodonWeights, RestrictionSite, TranslationTable
from codonlake.functions import display as D
from codonlake.functions import tools as T
from codonlake.sources.genetic_code import NCBI_CODES


def test_tables():
    for k in NCBI_CODES:
        t = TranslationTable(k)
        assert len(t.codons_to_aa) == 64 and t.table_id == k and t.stop_codons == t.aa_to_codons.get("*", ())
    assert TranslationTable(2)["AGA"] == "*" and TranslationTable(12)["ctg"] == "S" and TranslationTable(1, rna=True)["AUG"] == "M"
    assert TranslationTable(27).stop_codons == ("TGA",)
    with pytest.raises(ValueError):
        TranslationTable(7)
    with pytest.raises(AttributeError):
        TranslationTable().name = "x"
    for bad in ("AT", "XXX", 3):
        with pytest.raises(KeyError):
            TranslationTable()[bad]


def test_translate_and_normalise():
    t = TranslationTable()
    assert t.translate("AUGAAA") == "MK" and t.normalise_sequence("au g") == "ATG"
    for bad in ("ATGA", "ATX", "ATG\n"):
        with pytest.raises(ValueError):
            t.translate(bad)
    with pytest.raises(KeyError):
        TranslationTable.custom({"AAA": "K"}).translate("AAC")


def test_custom_and_copies():
    t = TranslationTable.custom({"UUU": "f", "AAA": "*"}, "Mine")
    assert t.table_id is None and t.stop_codons == ("AAA",) and t["TTT"] == "F"
    assert pickle.loads(pickle.dumps(t)) == t and copy.deepcopy(t) is t
    for bad in ({}, {"AA": "K"}, {"AAA": "KK"}):
        with pytest.raises(ValueError):
            TranslationTable.custom(bad)


def test_weights():
    w = CodonWeights.ecoli()
    assert abs(sum(w.by_aa("l").values()) - 1) < 1e-12 and abs(w["TTT"] - 80995 / (80995 + 58774)) < 1e-12
    assert CodonWeights.uniform()["ATG"] == 1 and w.for_table(TranslationTable()) is w
    assert w.for_table(TranslationTable(1, rna=True))["UUU"] == w["TTT"]
    small, cut = w.threshold(0.2).restrict(TranslationTable())
    assert len(small.codons_to_aa) == len(cut) < 64 and "without" in small.name and w.threshold(0) is w
    for bad in ({"K": {"AAA": 1}, "k": {"AAG": 1}}, {"K": {"AAA": 1, "aaa": 1}}, {"K": {"AAA": -1}}, {"K": {"AAA": 0}}):
        with pytest.raises(ValueError):
            CodonWeights(bad)
    with pytest.raises(ValueError):
        CodonWeights({"K": {"AAA": 1}}).for_table(TranslationTable())


def test_organism_from_folder(tmp_path):
    (tmp_path / "mouse.txt").write_text("K AAA 3 AAG 1\n")
    assert CodonWeights.organism("mouse", str(tmp_path))["AAA"] == 0.75
    with pytest.raises(ValueError):
        CodonWeights.organism("nobody", str(tmp_path))


def test_sites():
    assert len(RestrictionSite) == 21 and RestrictionSite.EcoRI.motifs == ("GAATTC",) and RestrictionSite.BsaI.motifs == ("GGTCTC", "GAGACC")


def test_display():
    assert D.format_count(1234) == "1,234" and D.format_count(391 * 10**655) == "3.91 × 10^657"
    assert D.format_positions([1, 2, 3, 7]) == "1-3, 7" and D.format_positions([]) == "None"
    assert D.format_distance(None, 3) == "up to 3" and D.format_distance(2, None) == "at least 2" and D.format_distance(2, 2) == "2"
    assert D.format_restrictions({i: "AAA" for i in range(6)}, max_lines=2)[-1].endswith("4 more")
    assert D.format_forbidden_motifs(["ACU", RestrictionSite.EcoRI]) == "ACT, EcoRI (GAATTC)"


def test_tools():
    import itertools

    from test_space import repeat

    for t in map("".join, itertools.product("ACGT", repeat=6)):
        for length, lo, hi in ((2, 0, None), (2, 1, 2), (3, 0, None)):
            assert T.contains_direct_repeat(t, length, lo, hi) == repeat(t, length, lo, hi, False)
            assert T.contains_inverted_repeat(t.lower().replace("t", "u"), length, lo, hi) == T.contains_hairpin(t, length, lo, hi) == repeat(t, length, lo, hi, True)
    assert T.choice_masks(["ATG", "CUG"]) == [3, 8, 4] and T.pack_masks([1, 2, 8]) == 0x821 and T.sequence_masks("acgu") == [1, 2, 4, 8]
    with pytest.raises(ValueError):
        T.choice_masks(["A", "AC"])
    draws = T.Sampler("abc", [1, 0, 3], seed=1).sample(4000)
    assert "b" not in draws and abs(draws.count("c") / 4000 - 0.75) < 0.05 and T.Sampler("x").sample() == "x"
    for bad in ((), None), ("ab", [0, 0]), ("ab", [1]):
        with pytest.raises(ValueError):
            T.Sampler(*bad)
