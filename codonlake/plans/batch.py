"""Many spaces at once as DataFrames, and one large space spread over tasks.

Three strategies: native expressions where each position counts on its own or a given sequence is tested;
chained broadcast joins with the codon table for small spaces; the automaton kernel in Arrow batches for
everything else. A space is compiled in one task, thousands of them in parallel.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import sequence as S
from ..operators import rules as R
from ..operators.space import SpaceSpec
from ..sources.genetic_code import TranslationTable
from . import kernel as K


def degeneracy(aa: Column | str, table: TranslationTable | None = None) -> Column:
    """For each residue the number of its codons, as an array."""
    table = table or TranslationTable()
    n = F.create_map(*[F.lit(x) for a, c in table.aa_to_codons.items() for x in (a, len(c))])
    c = F.col(aa) if isinstance(aa, str) else aa
    return F.transform(F.split(c, ""), lambda a: F.try_element_at(n, a))


def _choices(c: Column, table: TranslationTable) -> dict[int, Column]:
    """How many residues have so many codons, for each such number: one pass over the text for each."""
    by: dict[int, str] = {}
    for residue, codons in table.aa_to_codons.items():
        by[len(codons)] = by.get(len(codons), "") + residue
    return {n: F.length(c) - F.length(F.translate(c, residues, "")) for n, residues in by.items()}


def log10_count(aa: Column | str, table: TranslationTable | None = None) -> Column:
    """log10 of the number of coding sequences of a protein without rules; null where a residue has no codon."""
    c = F.col(aa) if isinstance(aa, str) else aa
    out, known = F.lit(0.0), F.lit(0)
    for n, many in _choices(c, table or TranslationTable()).items():
        out, known = out + many * F.lit(math.log10(n)), known + many
    return F.when(known == F.length(c), out)


def exact_count(aa: Column | str, table: TranslationTable | None = None) -> Column:
    """The number of coding sequences as DECIMAL(38, 0); null beyond 10^37 or where a residue has no codon.

    A product of powers, each in parts that a double and a long hold exactly.
    """
    table = table or TranslationTable()
    c = F.col(aa) if isinstance(aa, str) else aa
    out = F.lit(1).cast("decimal(38,0)")
    for n, many in _choices(c, table).items():
        most = int(52 / math.log2(n)) if n > 1 else 0
        for k in range(math.ceil(37 / math.log10(n) / most) if n > 1 else 0):
            part = F.pow(F.lit(float(n)), F.least(F.greatest(many - k * most, F.lit(0)), F.lit(most)))
            out = (out * part.cast("long").cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(log10_count(c, table) < 37, out)


def exact_changes(aa: Column | str, codons: int, table: TranslationTable | None = None) -> Column:
    """How many coding sequences of a protein differ from any one of them in so many codons, as a long; null where a residue has no codon.

    A position with k codons can be left (1) or changed (k - 1): the coefficient of the product of those sums.
    """
    n = degeneracy(aa, table)
    none = [F.lit(1).cast("long")] + [F.lit(0).cast("long")] * codons
    moved = lambda acc: F.concat(F.array(F.lit(0).cast("long")), F.slice(acc, 1, codons))
    out = F.element_at(F.aggregate(n, F.array(*none), lambda acc, k: F.zip_with(acc, moved(acc), lambda x, y: x + y * (k - 1))), codons + 1)
    return F.when(~F.exists(n, lambda k: k.isNull()), out)


def codon_positions(spaces: DataFrame, table: TranslationTable, aa: str = "aa_seq") -> DataFrame:
    """One row per space, position (from 1) and codon: the residues joined to the broadcast codon table (64 rows)."""
    rows = spaces.select("*", F.posexplode(F.split(aa, "")).alias("pos0", "aa"))
    code = table.frame(spaces.sparkSession).select("aa", "codon", "codon_ord")
    return rows.withColumn("pos", F.col("pos0") + 1).drop("pos0").join(F.broadcast(code), "aa")


def enumerate_native(
    spaces: DataFrame, positions: int, table: TranslationTable | None = None, aa: str = "aa_seq", pins: dict[int, Sequence[str]] | None = None,
    near: tuple[str, int, int] | None = None, index: str | None = None,
) -> DataFrame:
    """All coding sequences of proteins of one small length: a chain of broadcast joins, no shuffle.

    near (column of a reference, least, most) keeps those at that distance in nucleotides; each join drops
    what is beyond it already. index names a column for the place of each sequence in the order of all
    (as text), which follows from the places of its codons; it goes with neither pins nor near.
    """
    table = table or TranslationTable()
    rows = [(a, c, i, len(own)) for a, own in table.aa_to_codons.items() for i, c in enumerate(sorted(own))]
    code = spaces.sparkSession.createDataFrame(rows, "__aa string, __codon string, __ord int, __of int")
    out = spaces.withColumns({"cds": F.lit(""), "__off": F.lit(0), "__idx": F.lit(0)})
    for p in range(1, positions + 1):
        own = code if not pins or p not in pins else code.where(F.col("__codon").isin(*pins[p]))
        out = out.join(F.broadcast(own), F.substring(aa, p, 1) == F.col("__aa")).withColumns({"cds": F.concat("cds", "__codon"), "__idx": F.col("__idx") * F.col("__of") + F.col("__ord")})
        if near:
            differ = sum((F.substring("__codon", k + 1, 1) != F.substring(near[0], 3 * p - 2 + k, 1)).cast("int") for k in range(3))
            out = out.withColumn("__off", F.col("__off") + differ).where(F.col("__off") <= near[2])
        out = out.drop("__aa", "__codon", "__ord", "__of")
    if near:
        out = out.where(F.col("__off") >= near[1])
    return (out.withColumn(index, F.col("__idx")) if index else out).drop("__off", "__idx")


def satisfies(cds: Column | str, rules: Sequence[R.Rule], context_l: str = "", context_r: str = "", rna: bool = False) -> Column:
    """A native predicate: the sequence in its context breaks no rule."""
    c = F.col(cds) if isinstance(cds, str) else cds
    full = F.concat(F.lit(context_l), c, F.lit(context_r)) if context_l or context_r else c
    out = F.lit(True)
    for r in rules:
        out = out & r.holds(full, c, rna)
    return out


def count_native(spaces: DataFrame, positions: int, rules: Sequence[R.Rule], keep: Sequence[str], context_l: str = "", context_r: str = "", table: TranslationTable | None = None, aa: str = "aa_seq") -> DataFrame:
    """n_valid by keep, summed over the rows that share it, of proteins of one small length under rules.

    The count follows from the protein alone, so the sequences of each distinct protein are listed and tested
    once: there are no more of them than texts of that many codons, however many rows ask.
    """
    table = table or TranslationTable()
    once = enumerate_native(spread(spaces.select(aa).distinct()), positions, table, aa)
    counts = once.groupBy(aa).agg(F.sum(satisfies("cds", rules, context_l, context_r, table.rna).cast("long")).alias("n_valid"))
    return spaces.join(counts, aa).groupBy(*keep).agg(F.sum("n_valid").alias("n_valid"))


def is_member(cds: Column | str, aa: Column | str, rules: Sequence[R.Rule] = (), table: TranslationTable | None = None, context_l: str = "", context_r: str = "") -> Column:
    """True where a sequence is one of the space of the protein under the rules: translation and predicates, no graph."""
    table = table or TranslationTable()
    c = S.normalise(cds, table.rna)
    a = F.col(aa) if isinstance(aa, str) else aa
    return F.coalesce(satisfies(c, rules, context_l, context_r, table.rna) & (S.translate(c, table) == a), F.lit(False))  # the cheap part first


# --- the kernel over rows -------------------------------------------------------------------------


def _kernel(df: DataFrame, fn: Callable[[dict], Iterator[Sequence[list]]], keep: Sequence[str], schema: str, rows: int = 4096) -> DataFrame:
    """keep, and what fn makes of each row: blocks of columns, as lists of one length in the order of the schema."""
    made = T._parse_datatype_string(schema).fields
    out = T.StructType([df.schema[c] for c in keep] + list(made))
    arrow = to_arrow_schema(out)

    def run(batches):
        sys.set_int_max_str_digits(0)  # counts of long proteins have more digits than Python shows by default
        for b in batches:
            own = [b.column(b.schema.get_field_index(c)) for c in keep]
            origin: list[int] = []
            columns: list[list] = [[] for _ in made]

            def full():
                at = pa.array(origin, pa.int64())
                kept = [c.take(at).cast(f.type) for c, f in zip(own, arrow)]
                return pa.RecordBatch.from_arrays(kept + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keep) :])], schema=arrow)

            for i, row in enumerate(b.to_pylist()):
                for block in fn(row):
                    origin += [i] * len(block[0])
                    for column, values in zip(columns, block):
                        column += values
                    if len(origin) >= rows:
                        yield full()
                        origin, columns = [], [[] for _ in made]
            yield full()

    return df.mapInArrow(run, out)


def spread(spaces: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deals spaces evenly to tasks: their cost is in the kernel, which the optimizer does not see."""
    return spaces.repartition(tasks or int(spaces.sparkSession.conf.get("spark.sql.shuffle.partitions")))


Build = Callable[[dict], SpaceSpec]


def from_columns(rules: Sequence[R.Rule] = (), table: TranslationTable | None = None, context_l: str = "", context_r: str = "", weights=None, aa: str = "aa_seq") -> Build:
    """A space from the protein column of a row; the rest is the same for all rows."""
    table = table or TranslationTable()
    kept: list[SpaceSpec] = []

    def build(row):
        if not kept:
            kept.append(SpaceSpec.make(row[aa], table, None, None, rules, context_l, context_r, weights))
        return kept[0].of(row[aa])

    return build


def from_json(column: str = "spec") -> Build:
    """A space from a column that SpaceSpec.to_json has written."""
    return lambda row: SpaceSpec.from_json(row[column])


@lru_cache(32)
def counted(spec: SpaceSpec) -> K.Counted:
    """The counted graph of a space, to list, rank and draw from; a task that meets a space again has it still."""
    return K.count(spec.graph(True), spec.logs(), dict(spec.pins))


@lru_cache(32)
def total(spec: SpaceSpec) -> int:
    """As counted, where only the number is asked."""
    return spec.total()


def log10_of(n: int) -> float | None:
    if not n:
        return None
    digits = str(n)
    return len(digits) - 1 + math.log10(float(digits[0] + "." + (digits[1:17] or "0")))


def count_spaces(spaces: DataFrame, build: Build, keep: Sequence[str]) -> DataFrame:
    """n_valid (decimal string of any size) and log10_valid (null if empty) of each row's space."""

    def fn(row):
        n = total(build(row))
        yield [str(n)], [log10_of(n)]

    return _kernel(spaces, fn, keep, "n_valid string, log10_valid double")


#: Places from the front up to which a range is sought without a graph.
FEW = 64


def enumerate_spaces(spaces: DataFrame, build: Build, keep: Sequence[str], start: int = 0, stop: int | None = None) -> DataFrame:
    """idx and cds for the places start .. stop - 1 of each space, streamed. A few from the front are sought without counting."""

    def fn(row):
        spec = build(row)
        if stop is not None and stop <= FEW and (found := K.foremost(spec.layout, spec.rules, stop, dict(spec.pins))) is not None:
            yield range(start, max(start, len(found))), found[start:]
            return
        c, at = counted(spec), start
        for block in c.blocks(start, c.total if stop is None else min(stop, c.total)):
            yield range(at, at + len(block)), block
            at += len(block)

    return _kernel(spaces, fn, keep, "idx long, cds string")


def sample_spaces(spaces: DataFrame, build: Build, keep: Sequence[str], n: int, seed: int | str = 0) -> DataFrame:
    """n sequences of each space (none if it is empty); the k-th of a row depends on seed, the kept columns and k only."""

    def fn(row):
        c = counted(build(row))
        if c.total:
            key = repr([row[k] for k in keep])
            for at in range(0, n, 4096):
                draws = range(at, min(at + 4096, n))
                yield draws, [c.draw(random.Random(f"{seed}|{key}|{k}")) for k in draws]

    return _kernel(spaces, fn, keep, "draw int, cds string")


def contains_spaces(candidates: DataFrame, build: Build, keep: Sequence[str], cds: str = "cds") -> DataFrame:
    """is_valid and rank (decimal string) of each row's sequence in its row's space, by walking the graph."""

    def fn(row):
        spec = build(row)
        rank = counted(spec).rank(spec.table.normalise_sequence(row[cds]))
        yield [rank is not None], [None if rank is None else str(rank)]

    return _kernel(candidates, fn, keep, "is_valid boolean, rank string")


def edges(spaces: DataFrame, build: Build, keep: Sequence[str]) -> DataFrame:
    """The counted graph as rows: pos, state, ord, codon, next_state, n_desc (decimal string), log_weight, log_mass. Written as Parquet it is the stored form of a compiled space, see from_edges."""

    def fn(row):
        spec = build(row)
        c = K.count(spec.graph(), spec.logs(), dict(spec.pins))  # the states themselves are stored
        logs = c.logs
        for k, rows in enumerate(c.edges):
            counts, masses = [str(n) for n in c.counts[k + 1]], c.masses[k + 1]
            found = [(s, i, codon, t) for s, own in enumerate(rows) if c.counts[k][s] for i, (codon, t) in enumerate(own)]
            if found:
                states, places, codons, after = zip(*found)
                yield [k + 1] * len(found), states, places, codons, after, [counts[t] for t in after], [logs[x] for x in codons], [logs[x] + masses[t] for x, t in zip(codons, after)]

    return _kernel(spaces, fn, keep, "pos int, state int, ord int, codon string, next_state int, n_desc string, log_weight double, log_mass double")


def restored(rows: Iterable[dict]) -> K.Counted:
    """The counted graph of the rows of one space that `edges` has made."""
    rows = sorted(rows, key=lambda r: (r["pos"], r["state"], r["ord"]))
    length = max((r["pos"] for r in rows), default=0)
    most = [0] * (length + 1)
    for r in rows:
        most[r["pos"] - 1] = max(most[r["pos"] - 1], r["state"])
        most[r["pos"]] = max(most[r["pos"]], r["next_state"])
    graph: list[list[list[tuple[str, int]]]] = [[[] for _ in range(n + 1)] for n in most[:-1]]
    counts = [[0] * (n + 1) for n in most]
    masses = [[-math.inf] * (n + 1) for n in most]
    logs = {r["codon"]: r["log_weight"] for r in rows}
    for r in rows:
        k, t, n = r["pos"], r["next_state"], int(r["n_desc"])
        graph[k - 1][r["state"]].append((r["codon"], t))
        counts[k][t] = n
        masses[k][t] = r["log_mass"] - r["log_weight"] if r["log_weight"] > -math.inf else masses[k][t]
    if rows:
        counts[0][0] = sum(int(r["n_desc"]) for r in rows if r["pos"] == 1)
    return K.Counted(graph, counts, masses, logs)


def from_edges(stored: DataFrame, keys: Sequence[str], fn: Callable[[K.Counted], Iterable[dict]], schema: str) -> DataFrame:
    """keys and what fn makes of each space's counted graph, from the rows of `edges` (with their keys) instead of its rules.

    The rows of a space go to one task, as they came from one.
    """
    out = T.StructType([stored.schema[k] for k in keys] + list(T._parse_datatype_string(schema).fields))
    arrow = to_arrow_schema(out)

    def run(t: pa.Table) -> pa.Table:
        own = {k: t.column(k)[0].as_py() for k in keys}
        return pa.Table.from_pylist([own | x for x in fn(restored(t.to_pylist()))], schema=arrow)

    return stored.groupBy(*keys).applyInArrow(run, out)


# --- one large space ------------------------------------------------------------------------------


def _shared(spark: SparkSession, spec: SpaceSpec):
    c = counted(spec)
    c.masses
    c._wheels.clear()
    return c.total, spark.sparkContext.broadcast(c)  # the graph of one space; its states have a budget


def sample_frame(spark: SparkSession, spec: SpaceSpec, n: int, seed: int | str = 0) -> DataFrame:
    """draw, cds: n sequences of one space, drawn in parallel; each row has its own generator."""
    total, c = _shared(spark, spec)
    if not total:
        raise ValueError("The space is empty: nothing can be drawn.")
    return _kernel(spark.range(n).withColumnRenamed("id", "draw"), lambda row: iter([([c.value.draw(random.Random(f"{seed}|{row['draw']}"))],)]), ["draw"], "cds string")


def range_frame(spark: SparkSession, spec: SpaceSpec, start: int, stop: int, step: int = 1, block: int = 10_000) -> DataFrame:
    """idx (decimal string) and cds of the places start, start + step, ... before stop; blocks are sought and walked in parallel."""
    total, c = _shared(spark, spec)
    if start < 0 or stop < start or stop > total:
        raise IndexError(f"Range {start}-{stop} is out of bounds for {total} sequences.")
    n = len(range(start, stop, step))

    def fn(row):
        first, many = row["id"] * block, min(block, n - row["id"] * block)
        at = start + first * step
        if step == 1:
            for words in c.value.blocks(at, at + many):
                yield [str(i) for i in range(at, at + len(words))], words
                at += len(words)
        else:
            places = range(at, at + many * step, step)
            yield [str(i) for i in places], [c.value.at(i) for i in places]

    return _kernel(spark.range(-(-n // block)), fn, ["id"], "idx string, cds string").drop("id")
