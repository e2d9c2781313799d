"""SentencePiece encoding into the N best segmentations, and decoding."""

from __future__ import annotations

import math
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches

SPACE = "▁"
#: Code points of text after which what is found is handed on; it bounds memory only.
HAND_ON = 1 << 20
#: What a character outside the vocabulary costs below the lowest piece; it becomes its bytes.
BYTE_PENALTY = 10.0
#: Scores from here down mark pieces that the model file itself shuns.
NEVER = -1e8


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each entry, so many, one entry after the other."""
    ends = many.cumsum()
    return np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def room(x: np.ndarray, size: int) -> np.ndarray:
    """x with place for so many rows at least."""
    if len(x) >= size:
        return x
    out = np.zeros((max(size, len(x) * 3 // 2), *x.shape[1:]), dtype=x.dtype)
    out[: len(x)] = x
    return out


class Lattice:
    """Segmentations of texts into the pieces of a SentencePiece model, by the sum of the pieces' scores."""

    #: Segments whose segmentations are kept at once, and the longest that are kept. They bound memory only.
    KEEP, LONGEST_KEPT = 450_000, 64
    #: Segments whose lattices are searched together.
    TOGETHER = 20_000

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.pieces = {n: (i, sp.get_score(i)) for i, n in enumerate(self.names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.longest = max(map(len, self.pieces))
        #: Each beginning of a piece with the piece's score and ids, or None where it is no piece itself.
        self.starts = dict.fromkeys(n[:k] for n in self.pieces for k in range(1, len(n) + 1)) | {n: (w, (i,)) for n, (i, w) in self.pieces.items()}
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.floor = min(s for _, s in self.pieces.values() if s > NEVER) - BYTE_PENALTY
        # no piece goes on over a space after a letter, nor over a line's end: the lattice falls apart there
        assert not any(SPACE in n.lstrip(SPACE) or "\n" in n for n in self.pieces)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        # the beginnings of pieces as a tree: the node after each node and character
        node = {"": 0} | {t: k for k, t in enumerate(sorted(self.starts, key=len), 1)}
        edges = np.array([(node[t[:-1]] << 21 | ord(t[-1]), node[t]) for t in self.starts], dtype=np.int64)
        self.slots(*edges.T)
        self.node_score, self.node_id = np.full(len(node), np.nan), np.full(len(node), -1, dtype=np.int64)
        for t, known in self.starts.items():
            if known:
                self.node_score[node[t]], self.node_id[node[t]] = known[0], known[1][0]
        self.forget()

    def slots(self, edge: np.ndarray, to: np.ndarray) -> None:
        """A hash table of the tree's edges: each lies at most `probes` slots behind the one of its hash."""
        bits = int(4 * len(edge)).bit_length()
        self.shift, self.probes = np.uint64(64 - bits), 1
        free, left = np.ones((1 << bits) + 64, dtype=bool), np.arange(len(edge))
        self.edge, self.to = np.full(len(free), -1, dtype=np.int64), np.zeros(len(free), dtype=np.int64)
        at = self.slot(edge)
        while True:
            left = left[np.argsort(at[left], kind="stable")]
            mine = free[at[left]] & np.concatenate([[True], at[left[1:]] != at[left[:-1]]])
            taken = at[left[mine]]
            free[taken], self.edge[taken], self.to[taken] = False, edge[left[mine]], to[left[mine]]
            left = left[~mine]
            if not len(left):
                return
            at[left] += 1
            self.probes += 1

    def slot(self, edge: np.ndarray) -> np.ndarray:
        return ((edge.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def forget(self) -> None:
        """Empties what is kept: a number for each segment; by number its facts, its first option and whether it was met again; by option score and ids."""
        self.number: dict[str, int] = {}
        self.facts = np.zeros((1024, 3))  # best score, loss of the second, ids of the best
        self.first = np.zeros(1025, dtype=np.int64)  # and where the last one's options end
        self.again = np.zeros(1024, dtype=bool)
        self.scores, self.at = np.zeros(1024), np.zeros(1025, dtype=np.int64)
        self.flat = np.zeros(1024, dtype=np.int32)

    def forget_rare(self) -> None:
        """Drops the segments not met again since the last time, or all if the others are more than half of what may be kept."""
        often = np.flatnonzero(self.again[: len(self.number)])
        names = list(self.number)
        facts, first, scores, at, flat = self.facts, self.first, self.scores, self.at, self.flat
        self.forget()
        if len(often) > self.KEEP // 2:
            return
        for lo in range(0, len(often), self.TOGETHER):
            k = often[lo : lo + self.TOGETHER]
            options = spread(first[k], first[k + 1] - first[k])
            ids = spread(at[options], at[options + 1] - at[options])
            self.note([names[i] for i in k.tolist()], first[k + 1] - first[k], scores[options], at[options + 1] - at[options], flat[ids])

    def forward(self, s: str) -> np.ndarray | list[float]:
        """The Viterbi score of each place: the best of all segmentations of what stands before it."""
        starts, pieces, size = self.starts, self.pieces, len(s)
        best = [0.0] + [-math.inf] * size
        for i in range(size):
            b = best[i]
            for j in range(i + 1, min(i + self.longest, size) + 1):
                if (t := s[i:j]) not in starts:
                    break
                if (p := starts[t]) and b + p[0] > best[j]:
                    best[j] = b + p[0]
            if s[i] not in pieces and b + self.floor > best[i + 1]:
                best[i + 1] = b + self.floor
        return best

    def segment(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first: forward Viterbi, then A* from the end.

        A hypothesis is the path from a place to the end; the Viterbi score of the place is exactly what
        the rest can add, so complete paths come out in the order of their scores. Hypotheses stand for
        different segmentations, so those beyond as many as are still wanted can go. Of equal scores the
        one found first leads: paths are tried longest piece first.
        """
        best, starts, pieces = self.forward(s), self.starts, self.pieces
        heap: list = [(-best[len(s)], 0, len(s), 0.0, None)]
        out, serial = [], 0
        while heap and len(out) < n:
            _, _, at, done, path = heap.pop(0)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for i in range(max(0, at - self.longest), at):
                if p := starts.get(s[i:at]):
                    serial += 1
                    heap.append((-(best[i] + p[0] + done), serial, i, p[0] + done, (p[1], path)))
            if s[at - 1] not in pieces:
                serial += 1
                code = tuple(self.bytes[x] for x in s[at - 1].encode("utf-8", "surrogatepass"))
                heap.append((-(best[at - 1] + self.floor + done), serial, at - 1, self.floor + done, (code, path)))
            heap.sort()
            del heap[n - len(out) :]
        return out

    def arcs(self, cp: np.ndarray, seg: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start and end place, score and id (-1: the bytes of a character) of the lattice's arcs, by end place, longest first.

        cp are the characters of all segments, seg the segment of each, ends where each segment ends. A
        segment has a place more than characters.
        """
        found, at, node = [], np.arange(len(cp)), np.zeros(len(cp), dtype=np.int64)
        alone, last = np.ones(len(cp), dtype=bool), ends[seg]
        for k in range(self.longest):
            inside = at + k < last[at]
            at, node = at[inside], node[inside]
            key = node << 21 | cp[at + k]
            slot = self.slot(key)
            known = self.edge[slot] == key
            open_ = np.flatnonzero(~known)
            for step in range(1, self.probes):
                open_ = open_[self.edge[slot[open_] + step - 1] >= 0]  # an empty slot ends the search
                right = self.edge[slot[open_] + step] == key[open_]
                hit = open_[right]
                slot[hit], known[hit] = slot[hit] + step, True
                open_ = open_[~right]
            at, node = at[known], self.to[slot[known]]
            own = self.node_id[node]
            piece = own >= 0
            here = at[piece]
            found.append((here, self.node_score[node[piece]], own[piece]))
            if not k:
                alone[here] = False
        rest = np.flatnonzero(alone)
        # of one length, no two arcs end at the same place: each length, longest first, takes the next free one
        many = np.zeros(len(cp) + len(ends) + 1, dtype=np.int64)
        ways = [(at + seg[at], k, score, ids) for k, (at, score, ids) in enumerate(found, 1)]
        ways.insert(0, (rest + seg[rest], 1, np.full(len(rest), self.floor), np.full(len(rest), -1)))
        for at, k, _, _ in ways:
            many[at + k + 1] += 1
        free = many.cumsum()
        total = int(free[-1])
        start, end, score, ids = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64), np.empty(total), np.empty(total, dtype=np.int64)
        for at, k, own, names in reversed(ways):
            to = free[at + k]
            start[to], end[to], score[to], ids[to] = at, at + k, own, names
            free[at + k] += 1
        return start, end, score, ids

    def learn_all(self, segments: list[str], n: int) -> None:
        """Keeps the n best segmentations of new segments: what `segment` does, step by step for all of them at once.

        A segment has n rows for hypotheses, best first. The first is completed or goes on over all arcs that
        end where it begins, and what those lead to takes its place among the others, behind equal ones; as
        many stay as are still wanted.
        """
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        cp = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        of, ends = np.arange(len(sizes)), sizes.cumsum()
        base = ends - sizes + of  # the first place of each segment
        start, end, score, ids = self.arcs(cp, np.repeat(of, sizes), ends)
        first = np.append(0, np.bincount(end, minlength=len(cp) + len(sizes)).cumsum())
        best = np.full(len(cp) + len(sizes), -np.inf)
        best[base] = 0.0
        place = (np.arange(len(best)) - np.repeat(base, sizes + 1)).astype(np.int16)  # how far into its segment
        by_place = np.argsort(place, kind="stable")
        cuts = np.bincount(place).cumsum()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            to = by_place[lo:hi]
            many = first[to + 1] - first[to]
            k = spread(first[to], many)
            best[to] = np.maximum.reduceat(best[start[k]] + score[k], many.cumsum() - many)

        # hypotheses by number: where they begin, score, last arc, and the one that they go on from
        begins, paid, arc, parent = (room(x, 16 * len(sizes)) for x in (base + sizes, np.zeros(len(sizes)), np.full(len(sizes), -1), np.full(len(sizes), -1)))
        own, out, count = of, np.zeros(len(sizes), dtype=np.int64), len(sizes)
        results = np.full((len(sizes), n), -1)
        f, ref = np.full((n, len(own)), -np.inf), np.zeros((n, len(own)), dtype=np.int64)
        f[0], ref[0] = best[base + sizes], of
        while len(own):
            path = ref[0].copy()
            reached = begins[path]
            complete = reached == base[own]
            to = own[complete]
            results[to, out[to]] = path[complete]
            out[to] += 1
            f[:-1], ref[:-1], f[-1] = f[1:].copy(), ref[1:].copy(), -np.inf
            wanted = n - out[own]
            top = np.flatnonzero(~complete)
            path, last, begin = path[top], wanted[top] - 1, first[reached[top]]
            many = first[reached[top] + 1] - begin
            for j in range(int(many.max(initial=0))):
                if j:
                    more = np.flatnonzero(many > j)
                    if len(more) < len(many):
                        top, path, last, begin, many = top[more], path[more], last[more], begin[more], many[more]
                k = begin + j
                # the sums are taken as `segment` takes them, so that equal scores are equal here
                at, more, done = start[k], score[k], paid[path]
                hope = best[at] + more + done
                good = np.flatnonzero(hope > f[last, top])
                x, hope, ids_of = top[good], hope[good], count + np.arange(len(good))
                count += len(good)
                if count > len(paid):
                    begins, paid, arc, parent = (room(y, count) for y in (begins, paid, arc, parent))
                new = slice(count - len(good), count)
                begins[new], paid[new], arc[new], parent[new] = at[good], more[good] + done[good], k[good], path[good]
                less = np.zeros(len(x), dtype=bool)
                for q in range(n):  # the new one stands before the first that is less; that one and the rest move on
                    now, there = f[q, x], ref[q, x]
                    less |= now < hope
                    f[q, x], ref[q, x] = np.where(less, hope, now), np.where(less, ids_of, there)
                    hope, ids_of = np.where(less, now, hope), np.where(less, there, ids_of)
            for q in range(int(wanted.min()), n):
                f[q, wanted <= q] = -np.inf
            live = f[0] > -np.inf
            if not live.all():
                own, f, ref = own[live], f[:, live], ref[:, live]
        held = np.arange(n) < out[:, None]
        own, log = np.repeat(of, out), results[held]
        done = paid[log]
        live, steps = np.arange(len(own)), []
        while len(live := live[arc[log[live]] >= 0]):  # a step of each path, from its beginning
            steps.append((live, arc[log[live]]))
            log[live] = parent[log[live]]
        long = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(own))
        k, ahead = np.empty(int(long.sum()), dtype=np.int64), long.cumsum() - long
        for step, (live, arcs) in enumerate(steps):
            k[ahead[live] + step] = arcs
        piece, many, line = ids[k], np.ones(len(k), dtype=np.int64), np.repeat(np.arange(len(own)), long)
        spelled = {i: [self.bytes[x] for x in segments[w][c - base[w]].encode("utf-8", "surrogatepass")] for i, w, c in ((i, own[line[i]], start[k[i]]) for i in np.flatnonzero(piece < 0).tolist())}
        for i, codes in spelled.items():
            many[i] = len(codes)
        flat, before = np.repeat(piece, many).astype(np.int32), many.cumsum() - many
        for i, codes in spelled.items():
            flat[before[i] : before[i] + many[i]] = codes
        self.note(segments, out, done, np.add.reduceat(many, ahead), flat)

    def note(self, segments: list[str], counts: np.ndarray, scores: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Keeps new segments: how many segmentations each has, and of these, one after the other, scores, numbers of ids and ids."""
        lo = len(self.number)
        hi, options = lo + len(segments), self.first[lo]
        used = self.at[options]
        self.facts, self.again = room(self.facts, hi), room(self.again, hi)
        self.first, self.at = room(self.first, hi + 1), room(self.at, options + len(scores) + 1)
        self.scores, self.flat = room(self.scores, options + len(scores)), room(self.flat, used + len(flat))
        first = counts.cumsum() - counts
        several = counts > 1
        facts = self.facts[lo:hi]
        facts[:, 0], facts[:, 1], facts[:, 2] = scores[first], math.inf, sizes[first]
        facts[several, 1] = scores[first[several]] - scores[first[several] + 1]
        self.first[lo + 1 : hi + 1] = options + counts.cumsum()
        self.scores[options : options + len(scores)] = scores
        self.at[options + 1 : options + len(scores) + 1] = used + sizes.cumsum()
        self.flat[used : used + len(flat)] = flat
        self.number.update(zip(segments, range(lo, hi)))

    def options(self, k: int) -> list[tuple[float, np.ndarray]]:
        """The segmentations of a kept segment by its number."""
        return [(float(self.scores[i]), self.flat[self.at[i] : self.at[i + 1]]) for i in range(self.first[k], self.first[k + 1])]

    def keep(self, segments: list[str], n: int) -> np.ndarray:
        """The numbers of segments; learns those that are new."""
        if self.kept_for != n:
            self.forget()
            self.kept_for = n
        numbers = np.fromiter(map(self.number.get, segments, repeat(-1)), dtype=np.int64, count=len(segments))
        self.again[numbers[numbers >= 0]] = True
        missing = np.flatnonzero(numbers < 0)
        names = [segments[i] for i in missing.tolist()]
        new = list(dict.fromkeys(names))
        if self.number and len(self.number) + len(new) > self.KEEP:
            self.forget_rare()
            if self.number and len(self.number) + len(new) > self.KEEP:
                self.forget()
            return self.keep(segments, n)
        short = [s for s in new if len(s) <= self.LONGEST_KEPT]
        for at in range(0, len(short), self.TOGETHER):
            self.learn_all(short[at : at + self.TOGETHER], n)
        for s in new:
            if len(s) > self.LONGEST_KEPT:
                own = self.segment(s, n)
                flat = [np.array(ids, dtype=np.int32) for _, ids in own]
                self.note([s], np.array([len(own)]), np.array([x for x, _ in own]), np.array([len(x) for x in flat]), np.concatenate(flat))
        numbers[missing] = np.fromiter(map(self.number.__getitem__, names), dtype=np.int64, count=len(names))
        return numbers

    def parts(self, text: str) -> list[str]:
        """The segments of a text, which gets a space before it; spaces are ▁."""
        return self.segments((" " + text).replace(" ", SPACE))

    def segmentations(self, text: str | None, n: int, own: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a whole text; fewer if it has fewer segmentations, none if it is null or empty.

        own are the numbers of its segments, if they are kept already. The lattice is a chain of segments, so
        the n best differ from the best in few segments: any of them deviates in at most n - 1, and those with
        the least first loss suffice.
        """
        if not text:
            return []
        if own is None:
            own = self.keep(self.parts(text), n)
        score, loss, size = self.facts[own].T
        size = size.astype(np.int64)
        total, ends = score.sum(), size.cumsum()
        best = self.flat[spread(self.at[self.first[own]], size)]
        near = np.argsort(loss, kind="stable")[: n - 1]
        combos: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for i in near[np.isfinite(loss[near])].tolist():
            options = self.options(own[i])
            combos = sorted(((lost + options[0][0] - o[0], (*chosen, (i, k)) if k else chosen) for lost, chosen in combos for k, o in enumerate(options)), key=lambda c: c[0])[:n]
        out = []
        for lost, chosen in combos:
            pieces, at = [], 0
            for i, k in sorted(chosen):
                pieces += [best[at : ends[i] - size[i]], self.options(own[i])[k][1]]
                at = ends[i]
            out.append((float(total - lost), np.concatenate([*pieces, best[at:]])))
        return out

    kept_for = 0

    def encode(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a whole text, see segmentations."""
        return [(score, ids.tolist()) for score, ids in self.segmentations(text, n)]

    def decode(self, ids) -> str:
        """The text of ids: pieces with ▁ as space, bytes as UTF-8, without the space that encode puts first."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.raw_len[ids]
        ends = size.cumsum()
        at = np.repeat(self.raw_at[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        text = self.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Lattice] = {}


def lattice(model_file: str) -> Lattice:
    if model_file not in _loaded:
        _loaded[model_file] = Lattice(model_file)
    return _loaded[model_file]


def nbest(df: DataFrame, model_file: str, n: int = 3, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns to keep, rank (from 1), score, ids and decoded for each of the n best segmentations of each row's whole text.

    A null or empty text gives no rows; a text of any length is segmented whole; of segmentations that tie
    in score the one found first has the lower rank; repeated rows give theirs each; an empty table gives
    no rows. decoded is the text of the ids again. Where a column to keep has the name of one of the four,
    the new one has `_` after its name.
    """
    keep = keep or [c for c in df.columns if c != text_col]
    rank, scored, listed, shown, whole = fresh(df.select(*keep), "rank", "score", "ids", "decoded", "whole_text")

    def run(batches):
        for b in batches:
            lat = lattice(model_file)
            texts, lo = b.column(whole).to_pylist(), 0
            while lo < b.num_rows:  # as many texts as HAND_ON allows, one at least
                hi, seen = lo, 0
                while hi < b.num_rows and (hi == lo or seen + len(texts[hi] or "") <= HAND_ON):
                    seen += len(texts[hi] or "")
                    hi += 1
                parts = [lat.parts(t) if t else [] for t in texts[lo:hi]]
                numbers = lat.keep(list(chain.from_iterable(parts)), n)
                numbers = np.split(numbers, np.cumsum([len(x) for x in parts])[:-1])
                rows, out = [], []
                for i, own in enumerate(numbers, lo):
                    for k, (score, ids) in enumerate(lat.segmentations(texts[i], n, own), 1):
                        rows.append(i)
                        out.append((k, score, ids, lat.decode(ids)))
                at = pa.array(rows, type=pa.int64())
                ends = np.cumsum([0, *(len(x[2]) for x in out)], dtype=np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *(x[2] for x in out)])))
                yield {c: b.column(c).take(at) for c in keep} | {rank: [x[0] for x in out], scored: [x[1] for x in out], listed: flat, shown: [x[3] for x in out]}
                lo = hi

    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(df.select(*keep, F.col(text_col).alias(whole)), run, f"{ddl}, `{rank}` int, `{scored}` double, `{listed}` array<int>, `{shown}` string")
