"""An exact similarity join of documents on word n-grams through a token-group matrix.

1. Each text becomes its set of shingles; equal sets are one class. A class keeps its prefix (its rarest
   shingles: two sets that link share one of them) and a bitmap of its set, some bits a shingle.
2. Prefix shingles are kept where another class with the same one could link by size and by place in the
   order. A class joins the group of the most common one of its own, so near copies meet in one group; a
   group is bounded, larger ones are dealt to parts.
3. The matrix of (shingle, group) gives the pairs of groups that can link. A group's bitmaps make its
   union; the overlap of each set with the other group's union, then with its sets, is bounded before any
   set is moved, and only sets that qualify open the other group.
4. Sets that qualify are made once more from their texts and compared exactly, group by group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FILE_TEXTS, Scratch, components, dealt, fresh, map_batches, mix, written
from .words import shingle_sets

#: A group has at most about so many shingles and sets; a larger one is dealt to parts.
GROUP_TOKENS, GROUP_SETS = 300_000, 1024
#: Shingles that one task counts at once; those that it meets so often go into the counts of frequent ones;
#: from FREQUENT on a shingle counts as frequent; so many of them, the most frequent, are sent to the tasks.
#: None of these changes the result: they only order the shingles.
COUNTED, MET, FREQUENT, MOST_FREQUENT = 3_000_000, 2, 12, 400_000
#: Prefix shingles that one task of the matrix gets; those of a shingle counted over 2^HOT times are dealt to several.
BUCKET_TOKENS, HOT = 1_000_000, 20
#: Bits of a bitmap: the power of two from BITS times the set's size on, in these bounds.
BITS, LEAST_BITS, MOST_BITS = 4, 256, 1 << 17
#: Columns of the table of sets by shingles that are multiplied at once.
COLUMNS = 4096
#: Hash values of doc_id that mark candidates' rows.
FLAGS = 1 << 20
#: Neighbours of an entry of the matrix, by size, among which a partner is looked for.
LOOKED = 64

#: The set of each text of a column.
Sets = Callable[[pa.Array], list[np.ndarray]]

_A = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)


def least_overlap(n, percent: int):
    """The shingles that sets of n and of any size share at least if they link: ceil(percent * n / 100)."""
    return -(-(n * percent) // 100)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each shingle of a set, at its hash modulo the bitmap's size."""
    size = 1 << int(np.clip(BITS * len(s) - 1, LEAST_BITS - 1, MOST_BITS - 1)).bit_length()
    flags = np.zeros(size, dtype=bool)
    flags[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (bytes) in `size` bytes: halves are laid over each other. Bit k stands for hashes k modulo the size."""
    return bits if len(bits) <= size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def union(maps: list[np.ndarray]) -> np.ndarray:
    """The union of bitmaps; a smaller one stands for each hash that it may hold."""
    size = max(map(len, maps))
    out = np.zeros(size, dtype=np.uint8)
    for m in maps:
        out.reshape(-1, len(m))[:] |= m
    return out


def may_link(n: np.ndarray, maps: list[np.ndarray], lo: int, hi: int, other: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of n shingles can link to a set of lo to hi shingles within the union `other`.

    Shingles of a set that are in the union have their bits in both bitmaps; those that share a bit with
    others of the set are counted as if they were all in the union.
    """
    least = np.maximum(lo, least_overlap(n, percent))
    out = (least <= hi) & (lo * percent <= 100 * n)
    for i in np.flatnonzero(out):
        size = min(len(maps[i]), len(other))
        own = fold(maps[i], size)
        both = int(_ONES[own & fold(other, size)].sum()) + n[i] - int(_ONES[own].sum())
        out[i] = both * (100 + percent) >= percent * (n[i] + least[i])
    return out


def pairs_across(n: np.ndarray, maps: list[np.ndarray], m: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets of two groups can link, by their bitmaps in the size of the smallest."""
    size = min(map(len, [*maps, *others]))
    x, y = (np.unpackbits(np.stack([fold(k, size) for k in z]), axis=1).astype(np.float32) for z in (maps, others))
    both = x @ y.T + np.minimum((n - x.sum(axis=1))[:, None], (m - y.sum(axis=1))[None])
    ok = both * (100 + percent) >= percent * (n[:, None] + m[None])
    return ok & (np.minimum(n[:, None], m[None]) * 100 >= percent * np.maximum(n[:, None], m[None]))


def pairs_that_may_link(n: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a group can link to another one of it, by the bitmaps of each pair."""
    out = np.zeros(len(n), dtype=bool)
    sizes = np.array([len(m) for m in maps])
    for size in np.unique(sizes):  # the sizes of sets that link differ by a factor, so those of their bitmaps do
        rows = np.flatnonzero((sizes >= size) & (n * percent <= 100 * n[sizes == size].max()))
        if len(rows) < 2:
            continue
        flat = np.stack([fold(maps[i], size) for i in rows])
        x = np.unpackbits(flat, axis=1).astype(np.float32)
        m = n[rows]
        slack = m - x.sum(axis=1)
        both = x @ x.T + np.minimum(slack[:, None], slack[None])
        ok = both * (100 + percent) >= percent * (m[:, None] + m[None])
        ok &= np.minimum(m[:, None], m[None]) * 100 >= percent * np.maximum(m[:, None], m[None])
        np.fill_diagonal(ok, False)
        out[rows] |= ok.any(axis=1)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of left shares with each of right (None: left itself), as a product of tables of sets by shingles."""
    sets = left if right is None else [*left, *right]
    lens = np.array([len(s) for s in sets])
    u, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lens)
    several = n > 1
    column = np.cumsum(several) - 1
    keep = several[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    k = len(left)
    out = np.zeros((k, k if right is None else len(right)), dtype=np.float32)
    for lo in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[row[a:b], at[a:b] - lo] = 1
        out += x[:k] @ (x[:k] if right is None else x[k:]).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of left link to which of right (None: to which others of left)."""
    both = overlaps(left, right).astype(np.int64)
    a = np.array([len(s) for s in left])
    b = a if right is None else np.array([len(s) for s in right])
    out = 100 * both >= percent * (a[:, None] + b[None] - both)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def spanning(mask: np.ndarray) -> np.ndarray:
    """For the links of a square symmetric mask, the least number that each row reaches."""
    label = np.arange(len(mask))
    rows, cols = np.nonzero(mask)
    while True:
        nxt = label.copy()
        np.minimum.at(nxt, rows, label[cols])
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def frequent(docs: DataFrame, sets_of_texts: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and floor(log2) of their counts over all documents."""

    def run(batches):
        parts, size, seen = [], 0, set()

        def counted():
            u, c = np.unique(np.concatenate(parts), return_counts=True)
            often = c >= MET
            return {"token": pa.array(u[often].view(np.int64)), "n": pa.array(c[often].astype(np.int64))}

        for b in batches:
            for s in sets_of_texts(b.column("text")):
                key = hash(s.tobytes())
                if len(s) and key not in seen:  # equal sets are one set later on
                    seen.add(key)
                    parts.append(s)
                    size += len(s)
                if size >= COUNTED:
                    yield counted()
                    parts, size, seen = [], 0, set()
        if parts:
            yield counted()

    got = map_batches(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = got.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    token = rows["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(np.maximum(rows["n"].to_numpy(dtype=float)[order], 1)).astype(np.uint64)


def described(docs: DataFrame, sets_of_texts: Sets, percent: int) -> DataFrame:
    """rid, doc_id, row_a, row_b, n_shingles, sig_a, sig_b, lead, prefix and bits of every row.

    The prefix has the n - ceil(percent * n / 100) + 1 first shingles in one order of all shingles, rare
    ones first: two sets that link share at least one shingle of their prefixes. Only the first row of a
    set in a task leads and carries prefix and bits. row_a and row_b are hashes of doc_id and text.
    """
    token, level = frequent(docs, sets_of_texts)
    shared = docs.sparkSession.sparkContext.broadcast((token, level))  # 16 bytes for each of at most MOST_FREQUENT

    def run(batches):
        token, level = shared.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = {k: [] for k in ("n_shingles", "sig_a", "sig_b", "lead", "prefix", "bits")}
            for s in sets_of_texts(b.column("text")):
                size, sig = len(s), digest(s)
                lead = bool(size) and sig not in seen
                prefix = bits = None
                if lead:
                    seen.add(sig)
                    key = s >> np.uint64(5)
                    if len(token):
                        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        key |= np.where(token[at] == s, level[at] + np.uint64(1), np.uint64(0)) << np.uint64(59)
                    most = size - least_overlap(size, percent) + 1
                    key = np.partition(key, most - 1)[:most] if most < size else key
                    key.sort()
                    prefix = key.tobytes()
                    bits = bitmap(s)
                for k, v in zip(out, (size, *sig, lead, prefix, bits)):
                    out[k].append(v)
            yield {c: b.column(c) for c in ("doc_id", "row_a", "row_b")} | out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(docs.select("doc_id", "text", *row_key()), run, f"doc_id {kind}, row_a long, row_b long, n_shingles long, sig_a long, sig_b long, lead boolean, prefix binary, bits binary")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "described")


def row_key() -> list:
    """Two hashes that tell rows of different doc_id or text apart."""
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64("text", "doc_id", F.lit(7)).alias("row_b")]


def partnered(token: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by shingle and size, have another one of the shingle that they could link to.

    If it is the first shingle that two sets share, they share no more than either has from its place on.
    An entry that has not found a partner among LOOKED neighbours on either side counts as if it had.
    """
    found = np.zeros(len(token), dtype=bool)
    for side in (1, -1):
        at = np.arange(len(token))
        for step in range(1, LOOKED + 1):
            to = at + side * step
            inside = (to >= 0) & (to < len(token))
            at, to = at[inside], to[inside]
            near = (token[at] == token[to]) & (np.minimum(n[at], n[to]) * 100 >= percent * np.maximum(n[at], n[to]))
            at, to = at[near], to[near]
            ok = np.minimum(rest[at], rest[to]) * (100 + percent) >= percent * (n[at] + n[to])
            found[at[ok]] = True
            at = at[~found[at]]
            if not len(at):
                break
        found[at] = True
    return found


def postings(entries: DataFrame, n_entries: int, percent: int) -> DataFrame:
    """cid, token, f, rest: the prefix shingles of each class that make it a partner of another one, with the number of such classes.

    rest counts the set's shingles from this one on. Tasks pack their entries by bucket of the shingle. A
    very frequent shingle goes to several buckets by class; it is kept in each.
    """
    spark = entries.sparkSession
    buckets = int(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_entries // BUCKET_TOKENS))
    kinds = {"token": np.uint64, "cid": np.int64, "n": np.int32, "rest": np.int32}

    def pack(batches):
        for b in batches:
            p = b.column("prefix").to_pylist()
            long = np.array([len(x) // 8 for x in p], dtype=np.int64)
            token = np.frombuffer(b"".join(p), dtype=np.uint64)
            cid, n = (np.repeat(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64), long) for c in ("cid", "n"))
            rest = n - (np.arange(len(token)) - np.repeat(np.cumsum(long) - long, long))
            level = (token >> np.uint64(59)).astype(np.int64) - 1
            deal = np.where(level > HOT, mix(cid.view(np.uint64)) % (np.uint64(1) << np.maximum(level - HOT, 0).astype(np.uint64)), np.uint64(0))
            bucket = (mix(token + deal * _A) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=np.int64)
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            out = {c: v[order].astype(kinds[c]) for c, v in (("token", token), ("cid", cid), ("n", n), ("rest", rest))}
            yield {"bucket": [int(bucket[x]) for x, _ in spans]} | {c: [v[x:y].tobytes() for x, y in spans] for c, v in out.items()}

    def count(t: pa.Table) -> pa.Table:
        token, cid, n, rest = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=k) for c, k in kinds.items())
        order = np.lexsort((n, token))
        token, cid, n, rest = token[order], cid[order], n[order].astype(np.int64), rest[order].astype(np.int64)
        keep = partnered(token, n, rest, percent) | ((token >> np.uint64(59)) > np.uint64(HOT + 1))
        token, cid, rest = token[keep], cid[keep], rest[keep]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
        long = np.diff(np.append(head, len(token)))
        return pa.table({"cid": pa.array(cid), "token": pa.array(token.view(np.int64)), "f": pa.array(np.repeat(long, long).astype(np.int32)), "rest": pa.array(rest.astype(np.int32))})

    packed = map_batches(entries, pack, "bucket int, token binary, cid binary, n binary, rest binary")
    return packed.groupBy("bucket").applyInArrow(count, "cid long, token long, f int, rest int")


def grouped(postings: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """cid, rep, sig_a, sig_b, n, bits, kid, parts and grp of each class that shares a prefix shingle.

    kid stands for the most common one of its prefix shingles that others have; grp for kid and part.
    """
    key = postings.groupBy("cid").agg(F.max(F.struct("f", "token")).alias("m")).select("cid", F.shiftrightunsigned(F.xxhash64("m.token"), 20).alias("kid"))
    own = classes.select("cid", F.col("doc_id").alias("rep"), "sig_a", "sig_b", "n").join(key, "cid")
    large = own.groupBy("kid").agg(F.sum("n").alias("t"), F.count("*").alias("c"))
    large = large.withColumn("parts", F.least(F.lit(1 << 20), F.ceil(F.greatest(F.col("t") / GROUP_TOKENS, F.col("c") / GROUP_SETS))).cast("int")).where("parts > 1").select("kid", "parts")
    own = own.join(large, "kid", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = own.withColumn("grp", F.shiftleft("kid", 20) + F.pmod(F.xxhash64("cid"), F.col("parts")))
    return own.join(rows.where("lead").select(F.col("rid").alias("cid"), "bits"), "cid")


def group_pairs(postings: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """g1, g2 (g1 < g2), first, cid: pairs of groups of different kids that can link, and the sets of either (first: of g1) through which.

    The matrix has a cell for each shingle and group, with the sizes of the group's sets that have the
    shingle and the most that they have from it on. Cells of one shingle are paired; a set of a cell counts
    if it fits the other cell.
    """
    spark = groups.sparkSession
    matrix = postings.select("cid", "token", "rest").join(groups.select("cid", "grp", "n"), "cid")
    matrix = matrix.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def meet(t: pa.Table) -> pa.Table:
        token, grp, cid, n, rest = (t.column(c).to_numpy().astype(np.int64) for c in ("token", "grp", "cid", "n", "rest"))
        order = np.lexsort((grp, token))
        token, grp, cid, n, rest = (x[order] for x in (token, grp, cid, n, rest))
        head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])]))
        tail = np.append(head[1:], len(token))
        lo, hi, most = np.minimum.reduceat(n, head), np.maximum.reduceat(n, head), np.maximum.reduceat(rest, head)
        shingle, own = token[head], grp[head]
        ends = np.searchsorted(shingle, shingle, side="right")
        found, size, step = [np.zeros((0, 4), dtype=np.int64)], 0, 1
        at = np.arange(len(head))
        while len(at := at[at + step < ends[at]]):
            u, v = at, at + step
            ok = (own[u] >> 20 != own[v] >> 20) & (hi[u] * 100 >= lo[v] * percent) & (hi[v] * 100 >= lo[u] * percent)
            ok &= np.minimum(most[u], most[v]) * (100 + percent) >= percent * (lo[u] + lo[v])
            u, v = u[ok], v[ok]
            for first, x, y in ((1, u, v), (0, v, u)):
                many = tail[x] - head[x]
                to = np.repeat(y, many)
                row = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many) + np.repeat(head[x], many)
                fits = (n[row] * 100 >= lo[to] * percent) & (hi[to] * 100 >= n[row] * percent)
                fits &= np.minimum(rest[row], most[to]) * (100 + percent) >= percent * (n[row] + lo[to])
                row, to = row[fits], to[fits]
                a, b = (grp[row], own[to]) if first else (own[to], grp[row])
                found.append(np.stack([a, b, np.full(len(row), first), cid[row]], axis=1))
                size += len(row)
            if size > 500_000:
                found, size = [np.unique(np.concatenate(found), axis=0)], 0
            step += 1
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"g1": pa.array(pairs[:, 0]), "g2": pa.array(pairs[:, 1]), "first": pa.array(pairs[:, 2] == 1), "cid": pa.array(pairs[:, 3])})

    return matrix.groupBy("bucket").applyInArrow(meet, "g1 long, g2 long, first boolean, cid long").distinct()


def inside_groups(groups: DataFrame, percent: int) -> DataFrame:
    """grp, cid: the sets that may link to another one of their group."""

    def run(batches):
        for b in batches:
            out = {"grp": [], "cid": []}
            for grp, sets in zip(b.column("grp").to_pylist(), b.column("sets").to_pylist()):
                may = pairs_that_may_link(np.array([x["n"] for x in sets]), [np.frombuffer(x["bits"], dtype=np.uint8) for x in sets], percent)
                cids = [x["cid"] for x, ok in zip(sets, may) if ok]
                out["grp"] += [grp] * len(cids)
                out["cid"] += cids
            yield out

    sets = groups.groupBy("grp").agg(F.collect_list(F.struct("cid", "n", "bits")).alias("sets")).where("size(sets) > 1")  # a group is bounded
    return map_batches(sets, run, "grp long, cid long")


def qualifying(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """g1, g2, first, cid: the sets of either group that may link to a set of the other, by the other's union and then by pairs."""
    one = F.struct("cid", "n", "bits")
    both = pairs.join(groups.select("cid", "n", "bits"), "cid").groupBy("g1", "g2").agg(F.collect_list(F.when(F.col("first"), one)).alias("left"), F.collect_list(F.when(~F.col("first"), one)).alias("right"))  # groups are bounded

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("g1", "g2", "first", "cid")}
            for g1, g2, x, y in zip(*(b.column(c).to_pylist() for c in ("g1", "g2", "left", "right"))):
                if not x or not y:
                    continue
                n, m = (np.array([k["n"] for k in z]) for z in (x, y))
                own, other = ([np.frombuffer(k["bits"], dtype=np.uint8) for k in z] for z in (x, y))
                left = np.flatnonzero(may_link(n, own, m.min(), m.max(), union(other), percent))
                right = np.flatnonzero(may_link(m, other, n.min(), n.max(), union(own), percent)) if len(left) else left
                if not len(left) or not len(right):
                    continue
                ok = pairs_across(n[left], [own[k] for k in left], m[right], [other[k] for k in right], percent)
                for first, at, z in ((True, left[ok.any(axis=1)], x), (False, right[ok.any(axis=0)], y)):
                    for k, v in zip(out, ([g1] * len(at), [g2] * len(at), [first] * len(at), [z[j]["cid"] for j in at])):
                        out[k] += v
            yield out

    return map_batches(both, run, "g1 long, g2 long, first boolean, cid long")


def sets_of(docs: DataFrame, wanted: DataFrame, sets_of_texts: Sets) -> DataFrame:
    """cid, tokens of the wanted classes (cid, rep, sig_a, sig_b), from their texts; a repeated doc_id may give a set again.

    A broadcast of at most FLAGS hash values of doc_id keeps most other texts from the shuffle.
    """
    flag = lambda c: F.pmod(F.xxhash64(c), F.lit(FLAGS))
    flags = F.broadcast(wanted.select(flag("rep").alias("flag")).distinct())
    texts = docs.select("doc_id", "text").withColumn("flag", flag("doc_id")).join(flags, "flag", "left_semi").drop("flag").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batches):
        for b in batches:
            out = {"cid": [], "tokens": []}
            for cid, sa, sb, s in zip(*(b.column(c).to_pylist() for c in ("cid", "sig_a", "sig_b")), sets_of_texts(b.column("text"))):
                if digest(s) == (sa, sb):
                    out["cid"].append(cid)
                    out["tokens"].append(s.tobytes())
            yield out

    return map_batches(texts.select("cid", "sig_a", "sig_b", "text"), run, "cid long, tokens binary")


def _opened(sets: list[dict]) -> tuple[list[int], list[np.ndarray]]:
    once = {x["cid"]: x["tokens"] for x in sets}
    cids = sorted(once)
    return cids, [np.frombuffer(once[c], dtype=np.uint64) for c in cids]


def settle(inside: DataFrame, percent: int) -> DataFrame:
    """grp, a, b (links that connect what links within the group), rep, tokens (of its largest component's first set) and whole (it has all sets of the group)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cids, sets = _opened(b.column("sets")[i].as_py())
                label = spanning(linked(sets, None, percent))
                at = np.flatnonzero(label != np.arange(len(label)))
                most = np.bincount(label, minlength=len(label))
                rep = int(most.argmax())
                yield {
                    "grp": [b.column("grp")[i].as_py()],
                    "a": [[cids[k] for k in at]],
                    "b": [[cids[k] for k in label[at]]],
                    "rep": [cids[rep]],
                    "tokens": [sets[rep].tobytes()],
                    "whole": [int(most[rep]) == len(sets)],
                }

    sets = inside.groupBy("grp").agg(F.collect_list(F.struct("cid", "tokens")).alias("sets"))  # a group is bounded
    return map_batches(sets, run, "grp long, a array<long>, b array<long>, rep long, tokens binary, whole boolean")


def across(tiles: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what links between the sets of two groups (g1, g2, first, cid, tokens)."""

    def run(batches):
        for b in batches:
            out = {"a": [], "b": []}
            for i in range(b.num_rows):
                (left, x), (right, y) = _opened(b.column("left")[i].as_py()), _opened(b.column("right")[i].as_py())
                if not left or not right:
                    continue
                k = len(left)
                mask = np.zeros((k + len(right),) * 2, dtype=bool)
                mask[:k, k:] = linked(x, y, percent)
                mask |= mask.T
                ids, label = [*left, *right], spanning(mask)
                for j in np.flatnonzero(label != np.arange(len(label))):
                    out["a"].append(ids[j])
                    out["b"].append(ids[label[j]])
            yield out

    one = F.struct("cid", "tokens")
    sides = tiles.groupBy("g1", "g2").agg(F.collect_list(F.when(F.col("first"), one)).alias("left"), F.collect_list(F.when(~F.col("first"), one)).alias("right"))  # groups are bounded
    return map_batches(sides.select("left", "right"), run, "a long, b long")


def parted(settled: DataFrame, groups: DataFrame, percent: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and pairs (g1, g2) of parts of one kid.

    The largest component of each part is compared with that of the kid's first part. Parts that are whole
    and link there are connected, so they do not open each other: a group of near copies costs one
    comparison a part, whatever its size.
    """
    if not groups.where("parts > 1").limit(1).count():
        return settled.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false"), settled.select(F.col("grp").alias("g1"), F.col("grp").alias("g2")).where("false")
    reps = settled.join(groups.where("parts > 1").select("grp", "kid").distinct(), "grp").select("kid", "grp", "rep", "tokens", "whole")
    first = reps.groupBy("kid").agg(F.min("grp").alias("grp")).join(reps, ["kid", "grp"]).select("kid", F.col("rep").alias("to"), F.col("tokens").alias("other"))

    def run(batches):
        for b in batches:
            ok = [bool(linked([np.frombuffer(x, dtype=np.uint64)], [np.frombuffer(y, dtype=np.uint64)], percent)[0, 0]) for x, y in zip(b.column("tokens").to_pylist(), b.column("other").to_pylist())]
            yield {c: b.column(c) for c in ("kid", "grp", "rep", "to", "whole")} | {"linked": ok}

    star = map_batches(reps.join(first, "kid"), run, "kid long, grp long, rep long, to long, whole boolean, linked boolean")
    star = written(dealt(star, many), "parts")
    loose = star.where("not (linked and whole)").select("kid", F.col("grp").alias("x"))
    pairs = loose.join(star.select("kid", F.col("grp").alias("y")), "kid").where("x <> y").select(F.least("x", "y").alias("g1"), F.greatest("x", "y").alias("g2")).distinct()
    return star.where("linked and rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), pairs


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, sets_of_texts: Sets, percent: int) -> DataFrame:
    """a, b: links between classes of equal sets that connect all classes that are connected."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    total, many = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.count("*")).first()
    total = int(total or 0)
    leads = rows.where("lead").select(F.col("rid").alias("cid"), F.col("n_shingles").cast("int").alias("n"), "prefix").join(classes.select("cid"), "cid")
    posted = written(dealt(postings(leads, total, percent), many), "postings", scratch)
    groups = written(dealt(grouped(posted, classes, rows), many), "groups", scratch)
    meets = written(dealt(qualifying(group_pairs(posted, groups, percent), groups, percent), many), "meets", scratch)

    several = groups.where("parts > 1").select("grp", "cid")
    inside = written(dealt(inside_groups(groups, percent).union(several).distinct(), many), "inside", scratch)
    wanted = inside.select("cid").union(meets.select("cid")).distinct()
    sets = written(sets_of(docs, groups.select("cid", "rep", "sig_a", "sig_b").join(wanted, "cid"), sets_of_texts), "sets", scratch)
    settled = written(dealt(settle(inside.join(sets, "cid"), percent), many), "settled", scratch)
    star, apart = parted(settled, groups, percent, many)
    sides = apart.select("g1", "g2", F.lit(True).alias("first"), F.col("g1").alias("grp")).union(apart.select("g1", "g2", F.lit(False), "g2")).join(several, "grp").select("g1", "g2", "first", "cid")
    found = across(meets.union(sides).join(sets, "cid"), percent)
    within = settled.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    out = written(dealt(found.union(within).union(star), many), "found")
    scratch.drop()
    return out


def jaccard_rows(docs: DataFrame, n: int = 3, percent: int = 90, sets_of_texts: Sets | None = None) -> DataFrame:
    """rid, doc_id, row_a, row_b, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets: n-word shingles, or what
    sets_of_texts makes of a column of texts (sorted distinct 64-bit hashes). Rows with
    equal sets are one class; links between classes are verified on the full sets. component_id is the
    smallest doc_id reachable; kept is true for one row of each component, the one of smallest doc_id.

    A null text counts as empty: no set, no links, its own component. A null doc_id is smaller than none:
    it is a component's id only if all its rows have null. Repeated rows have equal sets, a tie for kept
    goes to the row read first. A text of any length is taken whole, its set is one row; sets above
    GROUP_TOKENS are groups of few. An empty table gives no rows.
    """
    return _rows(docs, sets_of_texts or partial(shingle_sets, n=n), percent)[0]


def _rows(docs: DataFrame, sets_of_texts: Sets, percent: int) -> tuple[DataFrame, int]:
    """What jaccard_rows gives, and how many rows it has."""
    rows = described(docs, sets_of_texts, percent)
    many = rows.count()
    by_sig = rows.where("n_shingles > 0").groupBy("sig_a", "sig_b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("rep"), F.min("rid").alias("cid"), F.min("n_shingles").alias("n"))
    classes = written(dealt(by_sig.select("cid", F.col("rep.doc_id").alias("doc_id"), F.col("rep.rid").alias("rep_rid"), "n", "sig_a", "sig_b"), many), "classes")
    roots = components(links(docs, rows, classes, sets_of_texts, percent), many)
    known = classes.select("cid", "doc_id", "rep_rid", "sig_a", "sig_b").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("component_id"), F.col("rep_rid").alias("kept_rid"))).alias("m"))
    named = known.join(least, "root").select("sig_a", "sig_b", "m.component_id", "m.kept_rid")
    joined = rows.drop("prefix", "bits", "lead").join(named, ["sig_a", "sig_b"], "left")
    alone = F.col("n_shingles") == 0
    out = joined.select("rid", "doc_id", "row_a", "row_b", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("rid") == F.col("kept_rid"))).alias("kept"))
    return out, many


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; see jaccard_rows."""
    out, many = _rows(docs, partial(shingle_sets, n=n), percent)
    return dealt(out.select("doc_id", "n_shingles", "component_id"), many)


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs without all but one of each component, all columns; see jaccard_rows.

    Rows that repeat doc_id and text are one another's copies: as many of them stay as are kept.
    """
    a, b, stay, rank = fresh(docs, "row_a", "row_b", "stay", "rank")
    found, many = _rows(docs, partial(shingle_sets, n=n), percent)
    kept = found.where("kept").groupBy(F.col("row_a").alias(a), F.col("row_b").alias(b)).agg(F.count("*").alias(stay))
    keyed = docs.withColumns({name: c for name, c in zip((a, b), row_key())}).join(written(dealt(kept, many), "kept"), [a, b])
    keyed = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(1))))
    return dealt(keyed.where(F.col(rank) <= F.col(stay)).select(*docs.columns), many, FILE_TEXTS)
