"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, hash of doc_id, hash of the row), so that
equal texts lie together. For each of the ``shards - 1`` splitters the exact bytes
below candidate boundaries are counted over all partitions; the interval that holds the
splitter's target is cut into 4096 new probes, until a boundary lies within the
tolerance or the interval holds a single row. Then the rows are exchanged once.

What reaches the driver is at most 4096 counts for each splitter and round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_column

#: Bits of a 64-bit key that each round of probes resolves.
STEPS = (12, 12, 12, 12, 12, 4)
KEYS = ("k0", "k1", "k2")


def _probe(level: int):
    """Key column, and the shift and width of the bits that round ``level`` counts by."""
    key, step = divmod(level, len(STEPS))
    done = sum(STEPS[: step + 1])
    return KEYS[key], 64 - done, STEPS[step]


def _prefix(level: int):
    """Columns that fix the bits resolved before ``level``."""
    key, step = divmod(level, len(STEPS))
    whole = [F.col(k) for k in KEYS[:key]]
    done = sum(STEPS[:step])
    return whole + ([F.shiftrightunsigned(KEYS[key], 64 - done)] if done else [])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def splitters(keyed: DataFrame, shards: int, tolerance: float, whole: float):
    """Boundaries (k0, k1, k2), as unsigned 64-bit numbers; a row belongs above those
    not larger than its own key. Also the rows below each 4096th of the first key."""
    top, deals = _probe(0), {}
    counts = (keyed.groupBy(F.shiftrightunsigned(top[0], top[1]).alias("b"))
              .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    total = sum(r["bytes"] for r in counts)
    rows = {r["b"]: r["rows"] for r in counts}
    slack, group = tolerance * total / shards, whole * total / shards
    # an open splitter: the bits resolved so far, one whole number a key, and the bytes below
    open_, found = {i: ((), 0) for i in range(1, shards)}, {}
    level, histogram = 0, {(): sorted((r["b"], r["bytes"], r["rows"]) for r in counts)}
    while open_:
        key, shift, width = _probe(level)
        ahead = {}
        for i, (path, below) in open_.items():
            target, at, cells = total * i / shards, below, histogram.get(path, [])
            for cell, size, held in cells:
                if at + size > target or cell == cells[-1][0]:
                    low, high = (path, cell, at), (path, cell + 1, at + size)
                    near = min((low, high), key=lambda e: abs(e[2] - target))
                    one = level + 1 == len(STEPS) and size <= group  # the rows of one text, few enough to stay together
                    if abs(near[2] - target) <= slack or one or held == 1 or level + 1 >= len(KEYS) * len(STEPS):
                        found[i] = (near[0], near[1], level)
                    else:
                        ahead[i] = (_deeper(path, cell, level), at)
                    break
                at += size
            else:
                found[i] = (path, 0, level)
        open_, level = ahead, level + 1
        if open_:
            paths = sorted({p for p, _ in open_.values()})
            key, shift, width = _probe(level)
            columns = _prefix(level)
            some = None
            for p in paths:
                same = None
                for c, v in zip(columns, p):
                    term = c == F.lit(_signed(v))
                    same = term if same is None else same & term
                some = same if some is None else some | same
            cell = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << width) - 1)) if shift else F.col(key).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            got = (keyed.where(some).groupBy(*[c.alias(f"p{j}") for j, c in enumerate(columns)], cell.alias("b"))
                   .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
            histogram = {}
            for r in got:
                path = tuple(r[f"p{j}"] % (1 << 64) for j in range(len(columns)))
                histogram.setdefault(path, []).append((r["b"], r["bytes"], r["rows"]))
            histogram = {p: sorted(c) for p, c in histogram.items()}
    return [_boundary(*found[i]) for i in range(1, shards)], rows


def _deeper(path, cell, level):
    key, step = divmod(level, len(STEPS))
    if step == 0:
        resolved = cell
        head = path
    else:
        head, resolved = path[:-1], (path[-1] << STEPS[step]) | cell
    return (*head, resolved)


def _boundary(path, cell, level):
    """The smallest key (k0, k1, k2) of a cell; a cell one beyond the last carries over."""
    key, step = divmod(level, len(STEPS))
    head, resolved = (path, cell) if step == 0 else (path[:-1], (path[-1] << STEPS[step]) + cell)
    whole = [*head, resolved << (64 - sum(STEPS[: step + 1]))]
    for j in range(len(whole) - 1, 0, -1):
        if whole[j] >= 1 << 64:
            whole[j] -= 1 << 64
            whole[j - 1] += 1
    return tuple(whole + [0] * (len(KEYS) - len(whole)))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, tolerance: float = 0.001, whole: float = 0.02, carry: tuple = ()) -> DataFrame:
    """Deal ``docs`` into shards of near equal bytes (UTF-8 bytes of the text plus 8 a row).

    Returns key, size, text_crc32, law, shard, slot (gapless from 0 in each shard),
    grown_shard (null under the law ``bytes``) and the columns in ``carry``; other
    columns of ``docs`` aren't read, whatever their names. A null text counts as
    empty (size 8, crc 0); null keys are dealt like others. Equal texts lie in one shard if
    they take no more than the share ``whole`` of a shard's bytes: a boundary among them moves to the nearer
    end, so a shard may be off by that share. Larger groups are split where the boundary falls. Rows equal in key and
    text are told apart by their place in the input. Texts of any length are one row. An empty table gives no rows.
    """
    body = text_column(docs, text)
    keyed = docs.select(
        docs[key].alias("id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("k0"), F.xxhash64(docs[key]).alias("k1"), F.xxhash64(F.monotonically_increasing_id()).alias("k2"),
        F.struct(*[docs[c] for c in carry]).alias("more") if carry else F.lit(None).cast("int").alias("more"))
    keyed = stored(keyed, "keys")
    cuts, rows = splitters(keyed, shards, tolerance, whole)
    flip = F.lit(-(1 << 63))
    mine = F.struct(*[F.col(k).bitwiseXOR(flip).alias(k) for k in KEYS])
    number = F.lit(0)
    for cut in cuts:
        if cut[0] >= 1 << 64:  # beyond the last key
            continue
        number = number + F.when(mine >= F.struct(*[F.lit(v - (1 << 63)).alias(k) for k, v in zip(KEYS, cut)]), 1).otherwise(0)
    # ranges of the first key, those with many rows split by the second: at most 4096 + 1024 of them
    n = sum(rows.values())
    spark = docs.sparkSession
    ways = [(b, max(1, -(-r * 1024 // max(n, 1)))) for b, r in rows.items()]
    ways = spark.createDataFrame(ways, "b long, ways long")
    dealt = (keyed.withColumn("shard", number.cast("int")).withColumn("b", F.shiftrightunsigned("k0", 52))
             .join(F.broadcast(ways), "b").withColumn("part", F.pmod("k1", "ways")))
    sizes = dealt.groupBy("shard", "b", "part").count().collect()
    first, at = [], {}
    for r in sorted(sizes, key=lambda r: (r["shard"], r["b"], r["part"])):
        first.append((r["shard"], r["b"], r["part"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["count"]
    first = spark.createDataFrame(first, "shard int, b long, part long, first long")
    order = Window.partitionBy("shard", "b", "part").orderBy("k0", "k1", "k2")
    out = (dealt.withColumn("place", F.row_number().over(order)).join(F.broadcast(first), ["shard", "b", "part"])
           .select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                   (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "more"))
    return out.select(*[c for c in out.columns if c != "more"], *[F.col(f"more.{c}").alias(c) for c in carry])
