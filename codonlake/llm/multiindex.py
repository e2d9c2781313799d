"""Near-duplicate embeddings through an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, map_batches, written

#: The codebooks are fitted on so many vectors of each length at most; a codebook has `codes` centres.
SAMPLE, ROUNDS = 8192, 12
#: Vectors of a row of cells that one tile holds on either side; a larger row is compared in several tiles.
TILE = 1024


def codes(rows: int) -> int:
    """Centres of each codebook: the product grid grows with the root of the number of vectors."""
    return int(np.clip(round(8 * (max(rows, 1) / 50_000) ** 0.25), 4, 256))


def codebook(z: np.ndarray, k: int) -> np.ndarray:
    """k-means centres, different from each other."""
    rng = np.random.default_rng(5)
    z = np.unique(z, axis=0)
    c = z[rng.choice(len(z), min(k, len(z)), replace=False)]
    for _ in range(ROUNDS):
        near = (np.square(c).sum(axis=1) - 2 * z @ c.T).argmin(axis=1)
        c = np.stack([z[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return np.unique(c, axis=0)


def bounds(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre, and a squared lower bound of its distance to each centre's region.

    A region lies on its centre's side of the bisecting plane with any other centre.
    """
    d = np.square(z).sum(axis=1)[:, None] - 2 * z @ c.T + np.square(c).sum(axis=1)
    apart = np.sqrt(np.square(c[:, None] - c[None]).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    least = np.zeros_like(d)
    for j in range(len(c)):
        np.maximum(least, (d - d[:, j : j + 1]) / (2 * apart[:, j]), out=least)
    return d.argmin(axis=1), np.square(least)


def visit(first: np.ndarray, second: np.ndarray, reach: float):
    """Cells (i, j) in the order of first[i] + second[j], as far as the reach: the multi-sequence traversal.

    Both halves are sorted; a heap holds the frontier of the grid, and a cell enters it once its
    neighbours before it in both sequences have been visited.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    u, v = first[a].tolist(), second[b].tolist()
    heap, done = [(u[0] + v[0], 0, 0)], [0] * len(u)
    while heap and heap[0][0] <= reach:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        done[i] = j + 1
        if i + 1 < len(u) and done[i + 1] == j and (j == 0 or done[i + 1] >= j):
            heapq.heappush(heap, (u[i + 1] + v[j], i + 1, j))
        if j + 1 < len(v) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))


def forest(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each of x and y reaches over the links of mask."""
    lx, ly = x.copy(), y.copy()
    rows, cols = np.nonzero(mask)
    while True:
        nx, ny = lx.copy(), ly.copy()
        np.minimum.at(nx, rows, ly[cols])
        np.minimum.at(ny, cols, nx[rows])
        if (nx == lx).all() and (ny == ly).all():
            return lx, ly
        lx, ly = nx, ny


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two each, so that squares neither overflow nor vanish; nothing is rounded."""
    _, power = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -power[:, None])


def raw(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", key_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept for each row: links between rows of one key whose cosine is at least `cosine`.

    Equal vectors of a key are one class with its number of rows. Each class lies in the cell of its
    nearest centres, one for each half of the unit vector, and visits cells in the order of a lower bound
    of their distance until that exceeds the greatest distance of a link, so the target recall is 1 and
    the fitted sample decides about speed only. Of two cells the one with the smaller number visits, and
    both sides are credited. A vector is sent once to each row of cells (those of one centre of the first
    half) with the numbers of the cells that it visits there. All visited pairs are verified in double
    precision, in tiles; a tile gives the number of links of each vector and links that span what it
    connects, not pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null key,
    have no links. Vectors of different lengths never link; each length has codebooks of its own, those
    that the sample lacks have one cell. Magnitudes are scaled by powers of two, so very small and very
    large components count in full. A null id is a component's id only if no other is reachable; kept is
    then true. Repeated rows count as links of each other. An empty table gives no rows. Vectors of any
    length go whole; a tile holds TILE of them on either side.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    key_type = vectors.schema[key_col].dataType.simpleString()
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    src = vectors.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    ok = F.coalesce(usable, F.lit(False))
    rows = src.withColumns({"ok": ok, "h1": F.when(ok, F.xxhash64("key", "v")), "h2": F.when(ok, F.xxhash64("v", "key", F.lit(7)))})
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("ok").groupBy("key", "h1", "h2").agg(F.min("rid").alias("cid"), F.count("*").alias("n"), F.min("id").alias("least_id"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "classes")
    total = classes.count()

    sample = classes.select("v", "dim").orderBy(F.xxhash64("cid")).limit(SAMPLE).toPandas()
    books = {}
    for dim, own in sample.groupby("dim")["v"]:
        if dim >= 2:
            z = scaled(np.stack(own.to_numpy()).astype(np.float64))
            z /= np.linalg.norm(z, axis=1, keepdims=True)
            k = min(codes(total), max(1, len(z) // 8))
            books[int(dim)] = codebook(z[:, : dim // 2], k), codebook(z[:, dim // 2 :], k)
    shared = spark.sparkContext.broadcast(books)  # at most 2 * 256 centres for each length that the sample has
    reach = 2 - 2 * cosine + 1e-9

    def places(b):
        """For each row of a batch: home cell (p, q), and p -> cells q to visit, its own cell included."""
        books, out = shared.value, [((0, 0), {0: [0]})] * b.num_rows
        dims = b.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            if dim not in books:
                continue
            at = np.flatnonzero(dims == dim)
            z = scaled(np.asarray(pc.list_flatten(b.column("v").take(pa.array(at))), dtype=np.float64).reshape(-1, dim))
            z /= np.linalg.norm(z, axis=1, keepdims=True)
            (na, la), (nb, lb) = bounds(z[:, : dim // 2], books[dim][0]), bounds(z[:, dim // 2 :], books[dim][1])
            for r, i in enumerate(at.tolist()):
                home = int(na[r]), int(nb[r])
                visits = {home[0]: [home[1]]}
                for cell in visit(la[r], lb[r], reach):
                    if cell > home:
                        visits.setdefault(cell[0], []).append(cell[1])
                out[i] = home, visits
        return out

    def bytes_of(b, at):
        flat = np.asarray(pc.list_flatten(b.column("v")), dtype=kind)
        ends = np.cumsum(b.column("dim").to_numpy(zero_copy_only=False))
        cut = [flat[e - d : e].tobytes() for e, d in zip(ends.tolist(), b.column("dim").to_pylist())]
        return [cut[i] for i in at]

    def members_of(batches):
        for b in batches:
            own = [home for home, _ in places(b)]
            yield {c: b.column(c) for c in ("key", "dim", "cid", "n")} | {"p": [p for p, _ in own], "q": [q for _, q in own], "v": bytes_of(b, range(b.num_rows))}

    def probes_of(batches):
        for b in batches:
            at, p, q, home = [], [], [], []
            for i, (own, visits) in enumerate(places(b)):
                for r, cells in visits.items():
                    at.append(i)
                    p.append(r)
                    q.append(bytes(cells))
                    home.append(own[1] if r == own[0] else -1)
            take = pa.array(at, type=pa.int64())
            yield {c: b.column(c).take(take) for c in ("key", "dim", "cid", "n")} | {"p": p, "q": q, "home": home, "v": bytes_of(b, at)}

    source = classes.select("key", "dim", "cid", "n", "v")
    members = map_batches(source, members_of, f"key {key_type}, dim int, cid long, n long, p int, q int, v binary")
    probes = map_batches(source, probes_of, f"key {key_type}, dim int, cid long, n long, p int, q binary, home int, v binary")
    at = ["key", "dim", "p"]
    sizes = members.groupBy(*at).agg(F.count("*").alias("m")).join(probes.groupBy(*at).agg(F.count("*").alias("n")), at).where("m > 1 or n > 1")
    sizes = written(sizes.select(*at, F.ceil(F.col("m") / TILE).cast("int").alias("mt"), F.ceil(F.col("n") / TILE).cast("int").alias("pt")), "sizes", scratch)
    deal = lambda tiles: F.pmod(F.xxhash64("cid"), F.col(tiles)).cast("int")
    each = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    left = members.join(sizes, at).withColumn("tm", deal("mt")).withColumn("tp", each("pt")).select(*at, "tm", "tp", "cid", "n", "q", "v")
    right = probes.join(sizes, at).withColumn("tp", deal("pt")).withColumn("tm", each("mt")).select(*at, "tm", "tp", "cid", "n", "q", "home", "v")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"cid": np.zeros(0, dtype=np.int64), "add": np.zeros(0, dtype=np.int64), "root": np.zeros(0, dtype=np.int64)}
        if a.num_rows and b.num_rows:
            a = a.sort_by("q")
            width = a.column("dim")[0].as_py()
            vy, vx = scaled(raw(a.column("v"), width, kind)), scaled(raw(b.column("v"), width, kind))
            sy, sx = np.linalg.norm(vy, axis=1), np.linalg.norm(vx, axis=1)
            y, ny, x, nx, qy = (t.column(c).to_numpy().astype(np.int64) for t, c in ((a, "cid"), (a, "n"), (b, "cid"), (b, "n"), (a, "q")))
            visits = np.zeros((len(x), 256), dtype=bool)
            for row, q in zip(visits, b.column("q").to_pylist()):
                row[list(q)] = True
            home = b.column("home").to_numpy()
            mask = np.zeros((len(x), len(y)), dtype=bool)
            more = np.zeros(len(y), dtype=np.int64)
            for q in np.unique(qy).tolist():
                lo, hi = np.searchsorted(qy, (q, q + 1))
                rows = np.flatnonzero(visits[:, q])
                near = vx[rows] @ vy[lo:hi].T
                near /= sx[rows, None]
                near /= sy[None, lo:hi]
                block = (near >= cosine) & (x[rows, None] != y[None, lo:hi])
                mask[rows, lo:hi] = block
                away = home[rows] != q  # a pair of one cell is met from either side
                more[lo:hi] += nx[rows][away] @ block[away]
            lx, ly = forest(mask, x, y)
            parts = (x, mask @ ny, lx), (y, more, ly)
            keep = [(add > 0) | (root != ids) for ids, add, root in parts]
            out = {c: np.concatenate([p[i][k] for p, k in zip(parts, keep)]) for i, c in enumerate(out)}
        return pa.table({c: pa.array(v.astype(np.int64)) for c, v in out.items()})

    tile = [*at, "tm", "tp"]
    found = written(left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, "cid long, add long, root long"), "found", scratch)
    roots = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("cid").agg(F.sum("add").alias("others"))
    known = classes.select("cid", "n", "least_id", "h1", "h2").join(linked, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = known.join(least, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    named = written(named, "linked")
    scratch.drop()
    out = rows.select("id", "ok", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
