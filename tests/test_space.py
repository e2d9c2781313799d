import itertools
import math
import random
import re

import pytest

from codonlake import CodingSpace, CodonWeights, DirectRepeats, ForbiddenMotifs, ForbiddenPaths, GC3Content, GCContent, Hairpins, InvertedRepeats, MaxHomopolymer, MutationDistance, RestrictionSite, TandemRepeats, TranslationTable
from codonlake.operators import rules
from codonlake.operators.rules import from_spec as rule_of
from codonlake.operators.rules import to_spec as spec_of
from codonlake.operators.space import MutationSpace, SpaceSpec, _Space
from codonlake.plans import kernel as K

TABLE = TranslationTable()


def sequences(aa, table=TABLE):
    return ["".join(x) for x in itertools.product(*[table.aa_to_codons[a] for a in aa])]


def repeat(t, length, lo, hi, inverted):
    for i in range(len(t) - length + 1):
        w = t[i : i + length]
        w = w.translate(str.maketrans("ACGT", "TGCA"))[::-1] if inverted else w
        for j in range(i + length + lo, len(t) - length + 1):
            if hi is not None and j - i - length > hi:
                break
            if t[j : j + length] == w:
                return True
    return False


@pytest.mark.parametrize(("aa", "n"), [("MIKEY", 24), ("CYIQNCPLG", 9216), ("SASSAFRAS", 995328), ("M", 1), ("*", 3)])
def test_counts(aa, n):
    assert CodingSpace(aa).count() == CodingSpace(aa).n_valid_sequences == n


def test_order_and_seed():
    s = CodingSpace("CYIQNCPLG", seed=42)
    assert s.sample() == "TGTTACATACAAAATTGTCCTCTAGGC"
    assert s[:3] == ["TGCTACATACAAAACTGCCCACTAGGA", "TGCTACATACAAAACTGCCCACTAGGC", "TGCTACATACAAAACTGCCCACTAGGG"]
    assert s[-1] == list(s)[-1] and s[9215] == s[-1]


def test_mutation_goldens():
    m = CodingSpace("MIKEY")
    assert m.mutants(m[0], max_nts=2).count() == 15
    s, ref = CodingSpace("SASSAFRAS"), "TCTGCTTCTTCTGCTTTTCGTGCTTCT"
    assert [s.mutants(ref, **k).count() for k in ({"min_nts": 1, "max_nts": 1}, {"max_nts": 3}, {"min_codons": 1, "max_codons": 1}, {"max_codons": 3})] == [25, 2208, 35, 5276]
    s = CodingSpace("SASSAFRAS", context_l="AAAAAA", context_r="GGGGGG", constraints=[ForbiddenMotifs(["TTTT", "AAATCT", "TCTGGG"])])
    ref = "TCCGCTTCTTCTGCTTTCCGTGCTTCC"
    assert (s.count(), s.mutants(ref, max_nts=5).count(), s.mutants(ref, min_codons=5, max_codons=5).count()) == (604800, 23155, 60866)


@pytest.mark.parametrize("trial", range(60))
def test_rules_against_rejection(trial):
    rng = random.Random(trial)
    aa = "".join(rng.choice("MKSRALGFPTW") for _ in range(rng.randint(1, 5)))
    left, right = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 6))) for _ in range(2))
    every = sequences(aa)
    if len(every) > 1200:
        every, aa = sequences(aa[:3]), aa[:3]
    length, lo = rng.randint(2, 4), rng.randint(0, 3)
    hi = rng.choice([None, lo, lo + 2, lo + 7])
    unit, copies, run = rng.randint(1, 4), rng.randint(2, 3), rng.randint(1, 4)
    motifs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(2, 4))) for _ in range(2)]
    rules = [
        (DirectRepeats(length, lo, hi), lambda t: not repeat(t, length, lo, hi, False)),
        (InvertedRepeats(length, lo, hi), lambda t: not repeat(t, length, lo, hi, True)),
        (Hairpins(length, lo, hi), lambda t: not repeat(t, length, lo, hi, True)),
        (TandemRepeats(unit, copies), lambda t: not re.search(f"(.{{{unit}}})\\1{{{copies - 1}}}", t)),
        (MaxHomopolymer(run), lambda t: not any(c * (run + 1) in t for c in "ACGT")),
        (ForbiddenMotifs(motifs), lambda t: not any(m in t for m in motifs)),
    ]
    chosen = rng.sample(rules, rng.randint(1, 3))
    want = [c for c in every if all(ok(left + c + right) for _, ok in chosen)]
    space = CodingSpace(aa, constraints=[r for r, _ in chosen], context_l=left, context_r=right)
    assert list(space) == want and space.count() == len(want)
    assert all(space.contains(c) == (c in want) for c in every[:50])
    assert [space[i] for i in range(len(want))] == want == space[:] and space[::-1] == want[::-1] and space[1:9:2] == want[1:9:2]
    assert list(space.enumerate_range(len(want) // 3, len(want))) == want[len(want) // 3 :]
    grown = CodingSpace(aa, context_l=left, context_r=right)
    grown.count()
    for r, _ in chosen:
        grown.add_constraints(r)
    assert list(grown) == want


@pytest.mark.parametrize("aa", ["K", "MIKEY", "SALLY"])
@pytest.mark.parametrize("motifs", [["AAA"], ["TT", "GAG"]])
@pytest.mark.parametrize("bounds", [{"max_nts": 2}, {"min_nts": 1}, {"min_codons": 1, "max_codons": 2}, {"min_nts": 2, "max_nts": 4, "min_codons": 2}])
def test_mutants_against_rejection(aa, motifs, bounds):
    every = [c for c in sequences(aa) if not any(m in "GG" + c + "T" for m in motifs)]
    space = CodingSpace(aa, constraints=ForbiddenMotifs(motifs), context_l="gg", context_r="t")
    if not every:
        assert space.count() == 0
        return
    ref = every[len(every) // 2]
    nts = lambda c: sum(a != b for a, b in zip(c, ref))
    codons = lambda c: sum(c[i : i + 3] != ref[i : i + 3] for i in range(0, len(c), 3))
    ok = lambda c: bounds.get("min_nts", 0) <= nts(c) <= bounds.get("max_nts", 99) and bounds.get("min_codons", 0) <= codons(c) <= bounds.get("max_codons", 99)
    assert [*space.mutants(ref, **bounds)] == [c for c in every if ok(c)]


def test_free_positions_pins_and_snapshot():
    space = CodingSpace("MIKEY")
    ref = "ATGATTAAAGAATAT"
    m = space.mutants(ref, free_positions=[2, 3])
    assert m.count() == 6 and m.frozen_positions == {1, 4, 5}
    space.pin_codons({2: "ATC"})
    assert space.count() == 8 and m.count() == 6
    m.freeze(2)
    assert m.count() == 2
    m.unfreeze_all()
    assert m.count() == 24 and m.free_positions == {1, 2, 3, 4, 5}
    m.set_distance_constraints(max_codons=1)
    assert m.count() == 1 + 2 + 1 + 1 + 1 and m.has_distance_constraints
    m.clear_distance_constraints()
    assert m.count() == 24
    m.freeze_all()
    assert list(m) == [ref]
    space.unpin_codons(2)
    assert space.count() == 24
    space.set_pinned_codons({1: "ATG", 4: ["GAA"]})
    assert space.count() == 12 and space.codon_options[4] == ("GAA",)
    space.clear_pinned_codons()
    space.set_constraints(ForbiddenMotifs("ATTAAA"))
    n = space.count()
    space.clear_constraints()
    assert n < space.count() == 24


def test_fixed_codons_keep_table_order():
    space = CodingSpace("MIKEY", fixed_codons={2: ["ATT", "ATC"]})
    assert space.count() == 16 and space.codon_options[2] == ("ATC", "ATT")
    with pytest.raises(ValueError):
        space.pin_codons({2: "ATA"})


@pytest.mark.parametrize("call", [
    lambda: CodingSpace(""), lambda: CodingSpace("MXB"), lambda: CodingSpace("MK", fixed_codons={3: "AAA"}), lambda: CodingSpace("MK", fixed_codons={2: []}),
    lambda: CodingSpace("MK", fixed_codons={2: "TTT"}), lambda: CodingSpace("MK").unpin_codons(9), lambda: CodingSpace("MK")["a"], lambda: CodingSpace("MK").mutants("TTTTTT"),
    lambda: CodingSpace("MK", translation_table=TABLE, rna=True), lambda: CodingSpace("KK", constraints=[ForbiddenMotifs(["A", "G"])]).sample(), lambda: CodingSpace("MK").contains("XYZ"),
    lambda: CodingSpace("MK").sample(-1), lambda: ForbiddenMotifs([]), lambda: ForbiddenMotifs("AXT"), lambda: MaxHomopolymer(0), lambda: TandemRepeats(2, 1), lambda: DirectRepeats(3, 5, 2), lambda: GCContent(min_frac=2), lambda: MutationDistance("ATGA"),
])
def test_value_errors(call):
    with pytest.raises(ValueError):
        call()


def test_other_errors():
    space = CodingSpace("MIKEY")
    for bad in (24, -25):
        with pytest.raises(IndexError):
            space[bad]
    with pytest.raises(IndexError):
        list(space.enumerate_range(3, 99))
    with pytest.raises(TypeError):
        len(space)
    for call in (lambda: MaxHomopolymer(True), lambda: ForbiddenMotifs([3]), lambda: TandemRepeats(2.5)):
        with pytest.raises(TypeError):
            call()
    assert space.sample(0) == [] and not space.contains("ATG")


def test_rna_and_other_codes():
    space = CodingSpace("MIKEY", translation_table=2, rna=True)
    assert set("".join(space)) <= set("ACGU") and "ATGATTAAAGAATAT" in space
    assert CodingSpace("MK", rna=True, constraints=[GCContent(max_frac=0.5), MaxHomopolymer(2)]).count() == 1
    custom = TranslationTable.custom({"AAA": "1", "AAC": "1", "GGG": "2"})
    assert list(CodingSpace("12", translation_table=custom)) == ["AAAGGG", "AACGGG"]


def test_gc_rules():
    for rule, value in ((GCContent(min_perc=40, max_perc=60), lambda c: 5 <= sum(x in "GC" for x in c) <= 7), (GC3Content(min_count=1, max_frac=0.5), lambda c: 1 <= sum(c[i] in "GC" for i in (2, 5, 8, 11)) <= 2)):
        assert list(CodingSpace("SALK", constraints=rule)) == [c for c in sequences("SALK") if value(c)]


def test_weights_and_sampling():
    weights = CodonWeights({a: {c: float(i + 1) for i, c in enumerate(x)} for a, x in TABLE.aa_to_codons.items()})
    rule = ForbiddenMotifs("TCA")
    space = CodingSpace("SK", codon_weights=weights, constraints=rule, seed=1)
    valid = [c for c in sequences("SK") if "TCA" not in c]
    mass = [weights[c[:3]] * weights[c[3:]] for c in valid]
    draws = space.sample(20000)
    for c, m in zip(valid, mass):
        p = m / sum(mass)
        assert abs(draws.count(c) / 20000 - p) < 5 * math.sqrt(p * (1 - p) / 20000)
    zero = CodonWeights({a: {c: float(i == 0) for i, c in enumerate(x)} for a, x in TABLE.aa_to_codons.items()})
    space.set_codon_weights(zero)
    assert space.count() == len(valid) and set(CodingSpace("K", codon_weights=zero).sample(20)) == {"AAA"}


def test_large_spaces():
    space = CodingSpace("MIKEY" * 100)
    assert space.count() == 24**100
    i = 10**100
    part = list(space.enumerate_range(i, i + 4))
    assert part == space[i : i + 4] == [space[i + k] for k in range(4)]
    assert space.counted.rank(part[2]) == i + 2


def test_save_load_copy(tmp_path):
    space = CodingSpace("MIKEY", seed=5, constraints=[ForbiddenMotifs([RestrictionSite.BsaI, "AAA"]), TandemRepeats(2)], codon_weights=CodonWeights.yeast(), context_l="GG")
    space.pin_codons({2: ["ATC", "ATA"]})
    space.sample(3)
    twin = space.copy()
    space.save(tmp_path / "s.json")
    back = CodingSpace.load(tmp_path / "s.json")
    assert back.spec == space.spec and back.sample(5) == space.sample(5) == twin.sample(5)
    m = CodingSpace("MIKEY").mutants("ATGATTAAAGAATAT", free_positions=[2, 3], max_nts=2)
    m.save(tmp_path / "m.json")
    back = _Space.load(tmp_path / "m.json")
    assert isinstance(back, MutationSpace) and list(back) == list(m) and back.free_positions == m.free_positions


def test_info():
    text = CodingSpace("MIKEY", constraints=[MaxHomopolymer(3), DirectRepeats(9)], context_l="GG", fixed_codons={2: "ATT"}).info()
    for part in ("Translation table: 1 (Standard)", "Molecule type: DNA", "    2: ATT", "Left context (2 nt):", "    Maximum homopolymer length: 3", "    Direct repeats: 1 constraint", "Num. valid coding sequences: "):
        assert part in text
    assert "    nts: up to 2" in CodingSpace("MIKEY").mutants("ATGATTAAAGAATAT", max_nts=2).info()


@pytest.mark.parametrize("trial", range(12))
def test_forbidden_paths(trial):
    rng = random.Random(trial)
    aa = "".join(rng.choice("SLKMG") for _ in range(4))
    free = list(CodingSpace(aa))
    paths = []
    for _ in range(rng.randint(1, 6)):
        places = sorted(rng.sample(range(1, 5), rng.randint(1, 3)))
        word = rng.choice(free)
        paths.append([(p, word[3 * p - 3 : 3 * p]) for p in places])
    want = [c for c in free if not any(all(c[3 * p - 3 : 3 * p] == x for p, x in path) for path in paths)]
    space = CodingSpace(aa, constraints=[ForbiddenPaths(paths)])
    assert list(space) == want and space.count() == len(want)
    assert list(CodingSpace(aa, constraints=[ForbiddenPaths([[(2, "ZZZ")], [(9, "AAA")]])])) == free
    assert rule_of(spec_of(ForbiddenPaths(paths))) == ForbiddenPaths(paths)


def test_forbidden_paths_found_for_a_layout():
    class NoPairs(ForbiddenPaths):
        """No codon twice in a row."""

        def paths(self, layout):
            return [((k, c), (k + 1, c)) for k in range(1, len(layout.codons)) for c in layout.choices[k] if c in layout.choices[k + 1]]

    free = list(CodingSpace("LLSS"))
    assert list(CodingSpace("LLSS", constraints=[NoPairs()])) == [c for c in free if c[:3] != c[3:6] and c[6:9] != c[9:]]


REPEATED = "VPGVGVPGAGVPGVGVPGVGIPGVGVPGVG"


@pytest.mark.parametrize(("rule", "other"), [(DirectRepeats(9, 0, 24), lambda t: repeat(t, 9, 0, 24, False)), (InvertedRepeats(6, 3, 24), lambda t: repeat(t, 6, 3, 24, True)), (Hairpins(5, 3, 20), lambda t: repeat(t, 5, 3, 20, True))])
def test_repeats_in_a_repetitive_protein(rule, other):
    """Draws from the space hold, and draws from the free space are members exactly if they hold."""
    aa = REPEATED[:13]
    space, free = CodingSpace(aa, constraints=[rule], seed=3), CodingSpace(aa, seed=4)
    drawn = free.sample(1500)
    inside = [c for c in drawn if not other(c)]
    assert all(not other(c) for c in space.sample(200)) and all(space.contains(c) == (not other(c)) for c in drawn)
    share = space.count() / free.count()
    assert abs(share - len(inside) / len(drawn)) < 5 * math.sqrt(max(share * (1 - share), 1e-3) / len(drawn))


def test_counting_and_storing_automata_agree():
    rng = random.Random(11)
    for _ in range(150):
        aa = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY*") for _ in range(rng.randint(1, 8)))
        lo = rng.randint(0, 5)
        rule = rng.choice((DirectRepeats, InvertedRepeats))(rng.choice((3, 3, 4)), lo, rng.choice((None, lo, lo + rng.randint(1, 9))))
        sides = ["".join(rng.choice("ACGT") for _ in range(rng.choice((0, 1, 2, 5)))) for _ in range(2)]
        spec = SpaceSpec.make(aa, rng.choice((None, TranslationTable(1, True))), None, None, [rule, *([ForbiddenMotifs("GAA")] if rng.random() < 0.3 else [])], *sides)
        stored, listed = (K.count(spec.graph(way), spec.logs()) for way in (False, True))
        assert stored.total == listed.total == spec.total()
        n = min(40, stored.total)
        assert list(stored.between(0, n)) == list(listed.between(0, n)) == [x for block in listed.blocks(0, n, 7) for x in block]


def test_the_first_few_need_no_graph():
    rng = random.Random(12)
    for k in range(150):
        aa = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY*") for _ in range(rng.randint(1, 8)))
        given = [ForbiddenMotifs(["GAAT", "TCT"]), MaxHomopolymer(2), DirectRepeats(3, 0, 6), TandemRepeats(2, 2), GCContent(min_perc=40, max_perc=60), InvertedRepeats(3, 1, 8)]
        spec = SpaceSpec.make(aa, rules=rng.sample(given, k % 4), context_l=rng.choice(("", "AAGGA")), context_r=rng.choice(("", "TTCCT")))
        pins = {1: spec.options(1)[-1:]} if k % 3 == 0 else {}
        try:
            want = list(K.count(spec.graph(), spec.logs(), pins).between(0, 7)) if (total := K.count(spec.graph(), spec.logs(), pins).total) > 7 else [K.count(spec.graph(), spec.logs(), pins).at(i) for i in range(total)]
        except ValueError:  # no sequence can have such GC content
            continue
        assert K.foremost(spec.layout, spec.rules, 7, pins) == want
    assert K.foremost(SpaceSpec.make("LLLLLLLL").layout, [DirectRepeats(6)], 7) is None


def test_blocks_are_the_places_in_order():
    counted = CodingSpace("MLSRK", constraints=[MaxHomopolymer(2)]).counted
    want = [counted.at(i) for i in range(counted.total)]
    for start, stop, most in ((0, counted.total, 4096), (3, 50, 5), (7, 7, 9), (counted.total - 1, counted.total, 1)):
        blocks = list(counted.blocks(start, stop, most))
        assert [x for b in blocks for x in b] == want[start:stop] and all(0 < len(b) <= most for b in blocks)


def test_windows_met_again_are_not_made_again(monkeypatch):
    rules._stocks.clear()
    made = []
    real = rules._Stock.start
    monkeypatch.setattr(rules._Stock, "start", lambda self, *a: (made.append(1), real(self, *a))[1])
    SpaceSpec.make("MKTLEFQNGS", rules=[DirectRepeats(3, 0, 6)]).graph()
    first = len(made)
    SpaceSpec.make("MKTLEFQNGSMKTLEFQNGS", rules=[DirectRepeats(3, 0, 6)]).graph()
    again = len(made) - first
    assert first and again < first
