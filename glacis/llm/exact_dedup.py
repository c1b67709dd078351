"""Exact deduplication with the frequent digests split off.

Misra-Gries summaries of the partitions name the digests that may be frequent; their
exact counts and winners are broadcast, so that their rows never move. The rest,
no group of which holds more than two in ``counters`` of all rows, is shuffled: digests
are counted by partial aggregates and joined with their counts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_column


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest): SHA-256 of the text with A-Z lower-cased, null being empty."""

    def run(batches):
        sha = hashlib.sha256
        for batch in batches:
            # bytes.lower() changes A-Z only
            texts = batch.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sha(t.lower()).digest() for t in texts.to_pylist()], pa.binary())], ["id", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("id"), text_column(docs, text).alias("text")).mapInArrow(run, f"id {kind}, digest binary")


def misra_gries(table: DataFrame, counters: int) -> DataFrame:
    """(digest, seen): each partition's summary of at most ``counters`` digests, which
    undercounts by at most one in ``counters`` of the partition's rows."""

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "seen"])

    return table.select("digest").mapInArrow(run, "digest binary, seen long")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = 1024) -> DataFrame:
    """One row a document, dropped ones too: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.
    The largest key of a group stays (nulls lose to any key; in a group of null keys
    keep_id is null and all rows of that key stay). Repeated rows with the winning key are
    all marked kept. Texts are read whole, however long. Only ``key`` and ``text`` are read, whatever else is there; an
    empty table gives no rows.
    """
    table = stored(digests(docs, key, text), "digests")
    n = table.count()
    hot = (misra_gries(table, counters).groupBy("digest").agg(F.sum("seen").alias("seen"))
           .where(F.col("seen") * counters >= n).select("digest"))
    hot = stored(hot, "frequent")  # at most ``counters`` rows, so it may be broadcast
    winners = table.join(F.broadcast(hot), "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = stored(winners, "winners")
    rows = table.join(F.broadcast(winners.withColumn("hit", F.lit(True))), "digest", "left")
    removed = rows.where("hit").select("digest", "id", "keep_id", "group_size")
    # counts and winners by partial aggregates; the join with them, of rows whose groups no longer are large, may be split
    left = rows.where("hit is null").select("digest", "id")
    groups = stored(left.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    rest = left.join(groups, "digest", "left").select("digest", "id", F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("id"))).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    return removed.union(rest).select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
