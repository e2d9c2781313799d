"""What the corpus operators share: table access, written stages, Arrow batches, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many links at most are settled by one task.
LAST = 1_000_000
#: Rows for each file of a table that is dealt to few, and of one that has texts.
FILE_ROWS, FILE_TEXTS = 50_000, 2000
#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and all is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="codonlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def dealt(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df, a table of about so many rows made by a shuffle, in few partitions where adaptive execution does not merge small ones; tasks before are as they are.

    Each task that writes has a file, and each file in a folder that Hadoop reaches as a local one costs two
    processes that the executor starts.
    """
    conf = df.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "coalescePartitions.enabled")):
        return df
    files = max(1, -(-rows // each))
    return df.repartition(files) if files < int(conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, is read again after the loss of an executor, and is compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that nothing reads any more once their last reader has been written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever their case, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with functions that yield dicts of columns."""
    small_batches(df.sparkSession)
    spark_schema = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold(key, parts: int):
    """A bucket from 0 to parts - 1 of a Spark column."""
    return F.pmod(F.xxhash64(key), F.lit(parts))


def reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and the least node that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        np.minimum.at(nxt, label[a], low)  # the roots move as well
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return node, node[label]
        label = nxt


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root for the links (a, b) of longs: nodes with the same root are connected.

    Rounds of contraction while there are more than LAST links: each node moves to the neighbour of least
    hash (twice along the chain), links between moved nodes remain. Hashes differ by round, so chains are
    short and the links shrink by a constant factor. A node with very many links is only summed up and
    joined to, never gathered. One task, not the driver, settles the last links, at most LAST. If about how
    many links there are is known, rows says it, see dealt.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left = written(left if rows is None else dealt(left, rows), "links", scratch)
    moves = []
    while (n := left.count()) > LAST:
        both = left.union(left.select("b", "a"))
        salt = F.lit(len(moves))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), "b")).alias("m"))
        step = least.select(F.col("a").alias("node"), F.when(F.struct(F.xxhash64("a", salt), "a") <= F.col("m"), F.col("a")).otherwise(F.col("m.b")).alias("to"))
        step = written(step, "moves", scratch)
        for _ in range(2):
            nxt = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = step.join(nxt, "to").select("node", F.col("next").alias("to"))
        step = written(step, "moves", scratch)
        moves.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = left.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        left = written(left, "links", scratch)

    def last(batches):
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if parts:
            node, root = reached(*(np.concatenate(x) for x in zip(*parts)))
            yield {"node": pa.array(node), "to": pa.array(root)}

    if n:
        moves.append(map_batches(left.coalesce(1), last, "node long, to long"))
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    found = moves[0].select("node", F.col("to").alias("root"))
    for step in moves[1:]:
        found = found.join(step.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = written(found, "roots")
    scratch.drop()
    return found
