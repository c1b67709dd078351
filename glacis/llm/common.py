"""Helpers that the corpus operators share: shared-folder tables and components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named and all runs in one process (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', f'glacis-{os.getpid()}')}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


#: Tables in the shared folder that are still there, in the order of their making.
_LIVE: dict[str, None] = {}
#: What holds while a table is written: Spark deletes the action's shuffle files as it ends, and hands rows to Python in small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs only the tasks that were running on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glacis-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _LIVE:
        atexit.register(lambda: [_drop(spark, p) for p in _LIVE])
    _LIVE[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        _LIVE.pop(t.stored_at, None)
        _drop(t.sparkSession, t.stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is stored meanwhile goes at the end, but for the tables that the given function is called with."""
    before, kept = set(_LIVE), []
    try:
        yield kept.append
    finally:
        for path in [p for p in _LIVE if p not in before and p not in [t.stored_at for t in kept]]:
            _LIVE.pop(path)
            _drop(spark, path)


def bitmap(keys: DataFrame, most: int = 26) -> tuple[np.ndarray, int]:
    """A bit map of the hashes ``key``, of eight bits each and 2 ** ``most`` bits at most in all (8 MB); where it
    fills up it only lets more through. With it the logarithm of its bits. It reaches the driver in pieces of 32 KB."""
    n = keys.count()
    bits = int(np.clip(np.ceil(np.log2(max(8 * n, 2))), 16, most))
    size = 1 << min(12, bits - 6)  # words of a piece

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(size, np.uint64)
        own[pdf["word"].to_numpy() % size] = pdf["held"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"at": [int(pdf["word"].iloc[0]) // size], "held": [own.tobytes()]})

    words = (keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held")))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.groupBy(F.expr(f"word div {size}").alias("at")).applyInPandas(piece, "at long, held binary").collect():
        out[r["at"] * size:(r["at"] + 1) * size] = np.frombuffer(r["held"], np.uint64)
    return out, bits


def held(words: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` (unsigned) the bit map may hold."""
    bit = keys >> np.uint64(64 - bits)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def ranked(rows: DataFrame, *by) -> DataFrame:
    """``rows`` with ``rank``, from 0 in the order of ``by`` over all of them, and ``range``, the part of the order that a row is in.

    Sorted by ranges: whatever key is frequent, no task holds more than its range. What reaches the driver, and is
    broadcast, is one count a range.
    """
    done = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ranked")
    done = done.withColumn("range", F.shiftright("at", 33).cast("int"))
    first, at = [], 0
    for r in done.groupBy("range").count().orderBy("range").collect():
        first.append((r["range"], at))
        at += r["count"]
    first = rows.sparkSession.createDataFrame(first, "range int, first long")
    return done.join(F.broadcast(first), "range").withColumn("rank", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "first")


def text_column(df: DataFrame, column: str):
    """The text with null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``links`` (a, b): rows (node, component),
    the component being the smallest node reachable.

    Alternates large-star and small-star steps: every step keeps one row a link, and
    a hub's smallest neighbour comes from a partial aggregate, so that no task
    gathers the neighbours of a node. Ends when the sum of the star edges no
    longer changes. Nodes without links don't appear. Null ends and self-links are
    left out.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "links")

    def state(e: DataFrame):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    seen = state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: each larger neighbour goes to the smallest of the closed neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours, and the node itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stored(small.where("u <> v").distinct(), "links")
        discard(before)
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))
