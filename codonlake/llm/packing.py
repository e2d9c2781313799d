"""Best-fit packing of documents into token sequences by bin completion."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, written
from .tokens import word_bpe

#: The id after each document.
END = 1
#: Pieces of one length are ranked in parts of about so many.
PART_ROWS = 2000
#: Steps of the branch and bound; states of at most FEW lengths that it remembers; pieces of a filling whose subsets are
#: all tried for dominance; places of the search that keep their enumeration open (others begin it anew and skip).
WORK, MOST_MET, FEW, SUBSETS, KEPT_OPEN = 400_000, 100_000, 64, 10, 32


def reachable(lengths: list[int], n: dict[int, int], room: int) -> list[int]:
    """Bitsets: bit k of the i-th is set if some of the first i lengths, as often as they are left, add up to k."""
    mask = (1 << (room + 1)) - 1
    out = [1]
    for k in lengths:
        bits, copies, step = out[-1], min(n[k], room // k), 1
        while copies > 0:
            step = min(step, copies)
            bits |= bits << (k * step) & mask
            copies -= step
            step *= 2
        out.append(bits)
    return out


def sums_to(target: int, lengths: list[int], n: dict[int, int], reach: list[int]) -> Iterator[tuple[int, ...]]:
    """The multisets of left lengths that add up to the target, long lengths first; none of the walk leads nowhere."""

    def steps(i: int, rest: int) -> Iterator[tuple[int, int, int]]:
        while i and reach[i] >> rest & 1:
            i -= 1
            k = lengths[i]
            for copies in range(min(n[k], rest // k), 0, -1):
                if reach[i] >> (rest - k * copies) & 1:
                    yield i, k, copies

    if not target:
        yield ()
        return
    open_, chosen, rest = [steps(len(lengths), target)], [()], target
    while open_:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            rest += sum(chosen.pop())
            continue
        i, k, copies = step
        if rest == k * copies:
            yield (*(x for part in chosen for x in part), *(k,) * copies)
        else:
            rest -= k * copies
            chosen.append((k,) * copies)
            open_.append(steps(i, rest))


def dominated(filling: tuple[int, ...], waste: int, lengths: list[int], n: dict[int, int]) -> bool:
    """Whether a left length could stand for some of the filling's pieces, or for none, and waste no more.

    Then a filling with it, and those pieces in its former place, is at least as good (Martello and
    Toth). Of fillings of over SUBSETS pieces only single pieces and pairs are tried, so fewer are dropped.
    """
    used: dict[int, int] = {}
    for k in filling:
        used[k] = used.get(k, 0) + 1
    sizes = range(len(filling) + 1) if len(filling) <= SUBSETS else range(3)
    tried = set()
    for m in sizes:
        for part in combinations(filling, m):
            total = sum(part)
            if (m, total) in tried:
                continue
            tried.add((m, total))
            at = bisect_left(lengths, total + (m == 1))  # a piece for itself changes nothing
            while at < len(lengths) and lengths[at] <= total + waste:
                if n[lengths[at]] > used.get(lengths[at], 0):
                    return True
                at += 1
    return False


def exact_fit(n: dict[int, int], room: int, lengths: list[int]) -> tuple[int, ...] | None:
    """One or two left pieces that fill the room, if there are any: nothing dominates them."""
    if not room or n.get(room):
        return (room,) if room else ()
    for k in reversed(lengths):
        if 2 * k < room:
            return None
        if n.get(room - k, 0) > (2 * k == room):
            return k, room - k
    return None


def fillings(n: dict[int, int], room: int, most_waste: int, spent: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, filling) of all undominated fillings of the room with left pieces, least waste first, found as they are asked for."""
    lengths = sorted(k for k, v in n.items() if v and k <= room)
    spent[0] += 1 + len(lengths) // 64
    first = exact_fit(n, room, lengths)
    if first is not None:
        yield 0, first
    reach = reachable(lengths, n, room)
    spent[0] += len(lengths)
    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> (room - waste) & 1:
            for filling in sums_to(room - waste, lengths, n, reach):
                spent[0] += 1 + len(filling)
                if filling != first and not dominated(filling, waste, lengths, n):
                    yield waste, filling


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on counts: the longest piece opens a bin, then always the longest one that fits goes in."""
    n = {k: v for k, v in counts.items() if v}
    lengths = sorted(n)
    runs = []
    while lengths:
        filling: dict[int, int] = {}
        room, at = capacity, len(lengths)
        while at := min(bisect_right(lengths, room), at):
            k = lengths[at - 1]
            copies = min(n[k], room // k)
            filling[k] = copies
            room -= k * copies
            at -= 1
        times = min(n[k] // v for k, v in filling.items())
        for k, v in filling.items():
            n[k] -= v * times
            if not n[k]:
                lengths.pop(bisect_left(lengths, k))
        runs.append((times, filling))
    return runs


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's L2 bound."""
    total = sum(k * v for k, v in counts.items())
    best = -(-total // capacity)
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in lengths], dtype=np.int64)
    for cut in [k for k in lengths.tolist() if k <= capacity // 2]:
        big, mid = lengths > capacity - cut, (lengths <= capacity - cut) & (lengths > capacity // 2)
        small = (lengths >= cut) & (lengths <= capacity // 2)
        room = int(((capacity - lengths[mid]) * n[mid]).sum())
        need = max(0, int((lengths[small] * n[small]).sum()) - room)
        best = max(best, int(n[big].sum() + n[mid].sum()) + -(-need // capacity))
    return best


def plan_bins(counts: dict[int, int], capacity: int, work: int = WORK) -> tuple[list[tuple[int, dict[int, int]]], int, int]:
    """Runs of equal bins for counts of lengths, their number, and a lower bound.

    Best-fit decreasing is the first incumbent. While it is above the lower bound, a depth-first search
    completes the bin of the longest left piece with each undominated filling, least waste first; a
    filling is repeated as often as it can be, then tried once. A branch ends when its waste exceeds
    what a solution of one bin fewer than the incumbent may have, or at a state met before with no more
    bins. The first descent is the best-fit completion. The search ends with the proof that nothing is
    better, at the lower bound, or, once the first descent is over, after `work` steps (lengths looked at),
    whatever the machine; what a step costs does not depend on the number of pieces.
    """
    n = {k: v for k, v in counts.items() if v > 0}
    bound = lower_bound(n, capacity)
    total = sum(k * v for k, v in n.items())
    runs = best_fit(n, capacity)
    bins = sum(t for t, _ in runs)
    spent, met, used, waste = [0], {}, 0, 0

    def options() -> Iterator[tuple[int, int, dict[int, int]]]:
        """(times, waste of a bin, filling) of the bin of the longest piece that is left."""
        big = max(n)
        left = n | {big: n[big] - 1}
        for lost, chosen in fillings(left, capacity - big, (bins - 1) * capacity - total - waste, spent):
            filling: dict[int, int] = {}
            for k in (big, *chosen):
                filling[k] = filling.get(k, 0) + 1
            most = min(n[k] // v for k, v in filling.items())
            yield most, lost, filling
            if most > 1:
                yield 1, lost, filling

    # [options or None, how many of them have been taken, the one that holds]; only the last KEPT_OPEN keep their options open
    frames: list[list] = [[options(), 0, None]] if bins > bound else []
    first = True  # the first descent has no limit: each step of it takes pieces for good
    while frames and bins > bound and (first or spent[0] < work):
        frame = frames[-1]
        if frame[2]:
            times, lost, filling = frame[2]
            for k, v in filling.items():
                n[k] = n.get(k, 0) + times * v
            used, waste, frame[2] = used - times, waste - times * lost, None
        if frame[0] is None:
            frame[0] = islice(options(), frame[1], None)
        step = next(frame[0], None)
        if step is None:
            frames.pop()
            first = False
            continue
        frame[1] += 1
        times, lost, filling = step
        if waste + times * lost > (bins - 1) * capacity - total:
            first = False
            continue
        for k, v in filling.items():
            n[k] -= times * v
            if not n[k]:
                del n[k]
        used, waste, frame[2] = used + times, waste + times * lost, step
        spent[0] += 1
        if not n:
            first = False
            if used < bins:
                runs, bins = [(f[2][0], f[2][2]) for f in frames], used
            continue
        if len(n) <= FEW:
            key = hash(frozenset(n.items()))
            if met.get(key, used + 1) <= used:
                continue
            if len(met) < MOST_MET:
                met[key] = used
        frames.append([options(), 0, None])
        if len(frames) > KEPT_OPEN:
            frames[-KEPT_OPEN - 1][0] = None
    return runs, bins, bound


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and rid: whole texts as ids and END, only longer ones cut."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            end = np.array([END], dtype="<u4").tobytes()
            for doc, ids in zip(b.column("doc_id").to_pylist(), word_bpe(tokenizer).encode(b.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long").withColumn("rid", F.monotonically_increasing_id())


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Documents become ids once; the driver gets the number of pieces of each length (at most `capacity`
    numbers) and plans runs of equal bins. Each piece finds its place from its rank among the pieces of
    its length, which is counted in parts, so a length that a third of all pieces have is spread.

    A null or empty text is the END id alone; a text of any length is taken whole and cut only above the
    capacity; repeated rows are packed each; null doc_ids are kept; pieces that tie in length, doc_id and
    piece take places in the order in which they were written; an empty table gives no rows. Columns of
    docs other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, bins, bound = plan_bins(counts, capacity)
    # for each length: from which rank on, which bins, how many in each, and where in the bin
    lines: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, filling in runs:
        at = 0
        for k in sorted(filling, reverse=True):
            lines.setdefault(k, []).append((used.get(k, 0), first, filling[k], at))
            used[k] = used.get(k, 0) + times * filling[k]
            at += k * filling[k]
        first += times
    flat = [(k, *x) for k in sorted(lines) for x in lines[k]]
    cols = np.array(flat, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(cols)  # a few lines for each of at most `capacity` lengths

    parts = F.broadcast(spark.createDataFrame([(k, -(-n // PART_ROWS)) for k, n in counts.items()], "length long, parts int"))
    ranked = pieces.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    sizes = ranked.groupBy("length", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.withColumn("within", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "rid")))
    ranked = ranked.join(sizes.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def run(batches):
        plan = shared.value
        wide = np.int64(1) << np.int64(44)
        keys = plan[:, 0] * wide + plan[:, 1] if len(plan) else np.zeros(0, dtype=np.int64)
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            x = plan[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            own = rank - x[:, 1]
            place = {"sequence_id": x[:, 2] + own // x[:, 3], "offset": x[:, 4] + own % x[:, 3] * length}
            yield {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {k: pa.array(v) for k, v in place.items()}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(ranked, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
