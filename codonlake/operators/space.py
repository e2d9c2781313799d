"""Spaces of coding sequences: an immutable description, and classes to work with one space at a time."""

from __future__ import annotations

import copy
import json
import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

from ..functions import display as D
from ..plans import kernel as K
from ..sources.genetic_code import TranslationTable
from ..sources.usage import CodonWeights
from . import rules as R

Codons = Mapping[int, str | Sequence[str]]


def _tuple(x) -> tuple:
    return () if x is None else (x,) if isinstance(x, (str, R.Rule)) else tuple(x)


@lru_cache(16)
def _logs(weights: CodonWeights | None, table: TranslationTable) -> dict[str, float]:
    return K.log_weights(dict((weights or CodonWeights.uniform(table)).items()))


@dataclass(frozen=True)
class SpaceSpec:
    """What defines a space. Everything else (graph, counts) is a function of it."""

    aa_seq: str
    table: TranslationTable
    fixed: tuple[tuple[int, tuple[str, ...]], ...] = ()
    rules: tuple[R.Rule, ...] = ()
    context_l: str = ""
    context_r: str = ""
    weights: CodonWeights | None = None
    pins: tuple[tuple[int, tuple[str, ...]], ...] = ()

    @classmethod
    def make(cls, aa_seq: str, table=None, rna: bool | None = None, fixed: Codons | None = None, rules=(), context_l: str = "", context_r: str = "", weights: CodonWeights | None = None) -> SpaceSpec:
        if table is None:
            table = TranslationTable(1, bool(rna))
        elif isinstance(table, int) and not isinstance(table, bool):
            table = TranslationTable(table, bool(rna))
        elif rna is not None and rna != table.rna:
            raise ValueError("rna contradicts the molecule of the translation table.")
        aa = aa_seq.upper()
        if not aa:
            raise ValueError("The amino acid sequence is empty.")
        for i, a in enumerate(aa, 1):
            if a not in table.aa_to_codons:
                raise ValueError(f"Invalid amino acid {a!r} at position {i}.")
        out = cls(aa, table, (), _tuple(rules), table.normalise_sequence(context_l), table.normalise_sequence(context_r), None if weights is None else weights.for_table(table))
        return replace(out, fixed=out.checked(fixed or {}))

    def checked(self, given: Codons) -> tuple[tuple[int, tuple[str, ...]], ...]:
        """Restrictions of positions (from 1) to synonymous codons, in the table's order."""
        out = {}
        for pos, codons in given.items():
            if isinstance(pos, bool) or not isinstance(pos, int) or not 1 <= pos <= len(self.aa_seq):
                raise ValueError(f"Position {pos} is out of range 1-{len(self.aa_seq)}.")
            wanted = {self.table.normalise_sequence(c) for c in _tuple(codons)}
            if not wanted:
                raise ValueError(f"No codons are given for position {pos}.")
            allowed = self.options(pos)
            if bad := sorted(wanted - set(allowed)):
                raise ValueError(f"Codons {', '.join(bad)} are not allowed for {self.aa_seq[pos - 1]} at position {pos}.")
            out[pos] = tuple(c for c in allowed if c in wanted)
        return tuple(sorted(out.items()))

    def options(self, pos: int) -> tuple[str, ...]:
        return dict(self.fixed).get(pos) or self.table.aa_to_codons[self.aa_seq[pos - 1]]

    @property
    def layout(self) -> R.Layout:
        return R.Layout(((self.context_l,), *(self.options(p) for p in range(1, len(self.aa_seq) + 1)), (self.context_r,)), self.table.rna)

    def logs(self) -> dict[str, float]:
        return _logs(self.weights, self.table)

    def of(self, aa_seq: str) -> SpaceSpec:
        """The space of another protein under the same rules; table, contexts and weights have been checked already."""
        if self.fixed or self.pins:
            raise ValueError("Fixed and pinned codons belong to one protein.")
        aa = aa_seq.upper()
        if not aa or not set(aa) <= self.table.aa_to_codons.keys():
            return SpaceSpec.make(aa_seq, self.table)  # says what is wrong
        return replace(self, aa_seq=aa)

    def graph(self, to_list: bool = False) -> K.Graph:
        return K.compile_graph(self.layout, self.rules, to_list=to_list)

    def total(self) -> int:
        """The number of sequences, where nothing else is asked."""
        return K.total(self.layout, self.rules, dict(self.pins))

    def to_json(self) -> str:
        t = self.table
        return json.dumps({
            "aa_seq": self.aa_seq, "table": {"table_id": t.table_id, "name": t.name, "rna": t.rna, "codons": dict(t.codons_to_aa)},
            "fixed": {p: list(c) for p, c in self.fixed}, "rules": [R.to_spec(r) for r in self.rules], "context_l": self.context_l, "context_r": self.context_r,
            "weights": None if self.weights is None else {a: dict(self.weights.by_aa(a)) for a in self.weights.amino_acids}, "pins": {p: list(c) for p, c in self.pins},
        })

    @classmethod
    def from_json(cls, text: str) -> SpaceSpec:
        d = json.loads(text)
        t = d["table"]
        table = TranslationTable(t["table_id"], t["rna"]) if t["table_id"] is not None else TranslationTable.custom(t["codons"], t["name"], t["rna"])
        out = cls.make(d["aa_seq"], table, None, {int(p): c for p, c in d["fixed"].items()}, [R.from_spec(r) for r in d["rules"]], d["context_l"], d["context_r"], CodonWeights(d["weights"]) if d["weights"] else None)
        return replace(out, pins=out.checked({int(p): c for p, c in d["pins"].items()}))


class _Space:
    """What coding and mutation spaces share: queries on a space that is compiled when it is first asked."""

    spec: SpaceSpec
    _rng: random.Random

    def __init__(self, spec: SpaceSpec, seed=None):
        self.spec = spec
        self._rng = random.Random(seed)
        self._graph: K.Graph | None = None
        self._counted: K.Counted | None = None

    # the graph depends on rules and codons, the counts on pins and weights as well
    def _changed(self, spec: SpaceSpec, graph: K.Graph | None) -> None:
        self.spec, self._graph, self._counted = spec, graph, None

    @property
    def counted(self) -> K.Counted:
        if self._counted is None:
            if self._graph is None:
                self._graph = self.spec.graph()
            self._counted = K.count(self._graph, self.spec.logs(), dict(self.spec.pins))
        return self._counted

    def compile(self) -> None:
        self.counted

    def count(self) -> int:
        return self.counted.total

    n_valid_sequences = property(count)

    def __len__(self):
        raise TypeError(f"{type(self).__name__} can be larger than len() allows; use count() or n_valid_sequences.")

    def __bool__(self):
        return True

    def contains(self, cds: str) -> bool:
        return self.counted.contains(self.spec.table.normalise_sequence(cds))

    __contains__ = contains

    def sample(self, n: int | None = None):
        counted = self.counted
        if not counted.total:
            raise ValueError("The space is empty: nothing can be drawn.")
        if n is None:
            return counted.draw(self._rng)
        if n < 0:
            raise ValueError("The number of draws cannot be below 0.")
        return [counted.draw(self._rng) for _ in range(n)]

    def seed(self, seed) -> None:
        self._rng = random.Random(seed)

    def enumerate(self) -> Iterator[str]:
        counted = self.counted
        yield from counted.between(0, counted.total)

    __iter__ = enumerate

    def enumerate_range(self, start: int, stop: int) -> Iterator[str]:
        counted = self.counted
        if start < 0 or stop < start or stop > counted.total:
            raise IndexError(f"Range {start}-{stop} is out of bounds for {counted.total} sequences.")
        yield from counted.between(start, stop)

    def __getitem__(self, key):
        counted = self.counted
        if isinstance(key, slice):
            r = range(counted.total)[key] if counted.total < 2**62 else _wide_slice(key, counted.total)
            if isinstance(r, range) and r.step == 1:
                return list(counted.between(r.start, r.stop))
            return [counted.at(i) for i in r]
        if isinstance(key, bool) or not isinstance(key, int):
            raise ValueError("Index must be an integer or a slice.")
        i = key + counted.total if key < 0 else key
        if not 0 <= i < counted.total:
            raise IndexError(f"Index {key} is out of range for {counted.total} sequences.")
        return counted.at(i)

    aa_seq = property(lambda self: self.spec.aa_seq)
    translation_table = property(lambda self: self.spec.table)
    codon_weights = property(lambda self: self.spec.weights or CodonWeights.uniform(self.spec.table))
    fixed_codons = property(lambda self: {p: c[0] if len(c) == 1 else list(c) for p, c in self.spec.fixed})
    context_l = property(lambda self: self.spec.context_l)
    context_r = property(lambda self: self.spec.context_r)
    pinned_codons = property(lambda self: dict(self.spec.pins))
    constraints = property(lambda self: self.spec.rules)

    @property
    def codon_options(self) -> dict[int, tuple[str, ...]]:
        pins = dict(self.spec.pins)
        return {p: pins.get(p) or self.spec.options(p) for p in range(1, len(self.aa_seq) + 1)}

    def set_codon_weights(self, weights: CodonWeights | None) -> None:
        self._changed(replace(self.spec, weights=None if weights is None else weights.for_table(self.spec.table)), self._graph)

    def clear_codon_weights(self) -> None:
        self.set_codon_weights(None)

    def copy(self):
        return copy.copy(self)

    def __copy__(self):
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out._rng = random.Random()
        out._rng.setstate(self._rng.getstate())
        return out

    def __deepcopy__(self, memo):
        return self.__copy__()

    def save(self, path: str) -> None:
        """The description as JSON; the graph follows from it."""
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self._stored(), f)

    @classmethod
    def load(cls, path: str):
        with open(path, encoding="utf-8") as f:
            return _restored(json.load(f))

    def _stored(self) -> dict:
        state = self._rng.getstate()
        return {"type": type(self).__name__, "spec": self.spec.to_json(), "rng": [state[0], list(state[1]), state[2]]}

    def __repr__(self) -> str:
        return self.info()

    def _head(self, rules, pins, pin_title: str) -> tuple[list[str], list[str]]:
        s, t = self.spec, self.spec.table
        head = [type(self).__name__, "", f"Translation table: {t.table_id} ({t.name})", f"Molecule type: {'RNA' if t.rna else 'DNA'}", "", f"Amino acid sequence ({len(s.aa_seq)} aa):", *D.format_sequence(s.aa_seq, 6), ""]
        rest = []
        for title, lines in (
            ("Codon restrictions:", D.format_restrictions(self.fixed_codons, "restricted positions", 4) if s.fixed else []),
            (f"Left context ({len(s.context_l)} nt):", D.format_sequence(s.context_l, 2)),
            (f"Right context ({len(s.context_r)} nt):", D.format_sequence(s.context_r, 2)),
            ("Constraints:", D.format_constraints(rules, t.rna, 4) if rules else []),
            (pin_title, D.format_restrictions(dict(pins), "pinned positions", 4) if pins else []),
        ):
            if lines:
                rest += [title, *lines, ""]
        return head, rest


def _wide_slice(key: slice, total: int):
    start, stop, step = key.indices(total)
    return range(start, stop, step)


class CodingSpace(_Space):
    """All coding sequences of a protein under rules.

    The setters replace the description; the graph is kept where only pins or weights change, and is
    extended where rules are added.
    """

    def __init__(self, aa_seq: str, *, translation_table=None, rna: bool | None = None, fixed_codons: Codons | None = None, constraints=(), context_l: str = "", context_r: str = "", codon_weights: CodonWeights | None = None, seed=None, compiler: str = "flat"):
        if compiler != "flat":
            raise ValueError(f"Unknown compiler {compiler!r}.")
        super().__init__(SpaceSpec.make(aa_seq, translation_table, rna, fixed_codons, constraints, context_l, context_r, codon_weights), seed)

    def pin_codons(self, pins: Codons) -> None:
        merged = dict(self.spec.pins) | dict(self.spec.checked(pins))
        self._changed(replace(self.spec, pins=tuple(sorted(merged.items()))), self._graph)

    def unpin_codons(self, positions: int | Iterable[int]) -> None:
        positions = [positions] if isinstance(positions, int) else list(positions)
        for p in positions:
            if not 1 <= p <= len(self.aa_seq):
                raise ValueError(f"Position {p} is out of range 1-{len(self.aa_seq)}.")
        self._changed(replace(self.spec, pins=tuple(x for x in self.spec.pins if x[0] not in positions)), self._graph)

    def set_pinned_codons(self, pins: Codons) -> None:
        self._changed(replace(self.spec, pins=self.spec.checked(pins)), self._graph)

    def clear_pinned_codons(self) -> None:
        self.set_pinned_codons({})

    def add_constraints(self, constraints) -> None:
        new = _tuple(constraints)
        if new:
            graph = None if self._graph is None else K.extend(self._graph, self.spec.layout, new)
            self._changed(replace(self.spec, rules=self.spec.rules + new), graph)

    def set_constraints(self, constraints) -> None:
        self._changed(replace(self.spec, rules=_tuple(constraints)), None)

    def clear_constraints(self) -> None:
        self.set_constraints(())

    def mutants(self, cds: str, free_positions=None, min_nts=None, max_nts=None, min_codons=None, max_codons=None, seed=None) -> MutationSpace:
        return MutationSpace(self, cds, free_positions=free_positions, min_nts=min_nts, max_nts=max_nts, min_codons=min_codons, max_codons=max_codons, seed=seed)

    def info(self) -> str:
        head, rest = self._head(self.spec.rules, self.spec.pins, "Temporary pins:")
        return "\n".join([*head, *rest, f"Num. valid coding sequences: {D.format_count(self.count())}"])


class MutationSpace(_Space):
    """The sequences of a space near a reference: some positions free, numbers of changes between bounds."""

    def __init__(self, space: CodingSpace, cds: str, *, free_positions=None, min_nts=None, max_nts=None, min_codons=None, max_codons=None, seed=None):
        cds = space.spec.table.normalise_sequence(cds)
        if not space.contains(cds):
            raise ValueError("The reference is not in the coding space.")
        super().__init__(space.spec, seed)
        space.counted
        self._base_spec, self._base_graph, self.cds = space.spec, space._graph, cds
        self._free = frozenset(range(1, len(space.aa_seq) + 1)) if free_positions is None else self._positions(free_positions)
        self._bounds = (None, None, None, None)
        self.set_distance_constraints(min_nts, max_nts, min_codons, max_codons)

    def _positions(self, positions) -> frozenset[int]:
        wanted = {positions} if isinstance(positions, int) else set(positions)
        if bad := sorted(p for p in wanted if isinstance(p, bool) or not isinstance(p, int) or not 1 <= p <= len(self.spec.aa_seq)):
            raise ValueError(f"Invalid positions: {bad}.")
        return frozenset(wanted)

    def _pins(self) -> tuple:
        frozen = {p: (self.cds[3 * p - 3 : 3 * p],) for p in self.frozen_positions}
        return tuple(sorted((dict(self._base_spec.pins) | frozen).items()))

    def _rebuilt(self, graph: K.Graph | None) -> None:
        rules = self._base_spec.rules + ((R.MutationDistance(self.cds, *self._bounds),) if self.has_distance_constraints else ())
        self._changed(replace(self._base_spec, rules=rules, pins=self._pins(), weights=self.spec.weights), graph)

    free_positions = property(lambda self: self._free)
    frozen_positions = property(lambda self: frozenset(range(1, len(self.spec.aa_seq) + 1)) - self._free)
    has_distance_constraints = property(lambda self: any(b is not None for b in self._bounds))
    min_nts, max_nts, min_codons, max_codons = (property(lambda self, i=i: self._bounds[i]) for i in range(4))

    def set_free_positions(self, positions) -> None:
        self._free = self._positions(positions)
        self._rebuilt(self._graph)

    def freeze(self, positions) -> None:
        self.set_free_positions(self._free - self._positions(positions))

    def unfreeze(self, positions) -> None:
        self.set_free_positions(self._free | self._positions(positions))

    def freeze_all(self) -> None:
        self.set_free_positions(())

    def unfreeze_all(self) -> None:
        self.set_free_positions(range(1, len(self.spec.aa_seq) + 1))

    def set_distance_constraints(self, min_nts=None, max_nts=None, min_codons=None, max_codons=None) -> None:
        rule = R.MutationDistance(self.cds, min_nts, max_nts, min_codons, max_codons)
        self._bounds = (min_nts, max_nts, min_codons, max_codons)
        graph = K.extend(self._base_graph, self._base_spec.layout, [rule]) if self.has_distance_constraints else self._base_graph
        self._rebuilt(graph)

    def clear_distance_constraints(self) -> None:
        self.set_distance_constraints()

    def _stored(self):
        return super()._stored() | {"base": self._base_spec.to_json(), "cds": self.cds, "free": sorted(self._free), "bounds": list(self._bounds)}

    def info(self) -> str:
        head, rest = self._head(self._base_spec.rules, self._base_spec.pins, "Inherited pins:")
        lines = [*head, f"Reference CDS ({len(self.cds)} nt):", *D.format_sequence(self.cds, 8), "", *rest, "Free positions:", f"    {D.format_positions(self._free)}", ""]
        if self.has_distance_constraints:
            lines += ["Mutation distance:", f"    nts: {D.format_distance(self.min_nts, self.max_nts)}", f"    codons: {D.format_distance(self.min_codons, self.max_codons)}", ""]
        return "\n".join([*lines, f"Num. valid variants: {D.format_count(self.count())}"])


def _restored(d: dict):
    base = object.__new__(CodingSpace)
    _Space.__init__(base, SpaceSpec.from_json(d["base"] if d["type"] == "MutationSpace" else d["spec"]))
    out = base
    if d["type"] == "MutationSpace":
        a, b, c, e = d["bounds"]
        pins = base.spec.pins
        base._changed(replace(base.spec, pins=()), None)
        out = MutationSpace(base, d["cds"], free_positions=d["free"], min_nts=a, max_nts=b, min_codons=c, max_codons=e)
        out._base_spec = replace(base.spec, pins=pins)
        out._rebuilt(out._graph)
    out._rng.setstate((d["rng"][0], tuple(d["rng"][1]), d["rng"][2]))
    return out
