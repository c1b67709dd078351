"""Exact Jaccard join on word shingles by vertical partitioning.

All shingles stand in one global order: those of one set only come first, then rare ones, then those that
a counting sketch calls frequent; hashes order the rest. Linked sets share one of the first shingles of
each, as many as a set may lack of the other and one more, so those of them that several sets have name the candidates. The order
is cut into fragments; each candidate pair's overlap is counted in each fragment separately and summed.

Components are what the join is for, so a bucket of one name first compares its
members with one hub, the member that shares most names. Where that leaves more than
one component around a hub, its members are compared in blocks, by bit maps of parities that bound the
difference of two sets; only what these don't rule out is counted. Members of a very large bucket are named anew
instead, by what they differ from the hub in: two sets that are linked differ from the hub in much the
same elements, so they share one of the first few of these in an order that puts elements beside the hub's, and rare
ones, first. Those names make new buckets, each with a hub of its own. No link between components is lost
that way; what is still large after ``DEEP`` rounds is compared in blocks too.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import blocks
from .common import bitmap, components, discard, stored, text_column
from .common import held as among
from .shingles import ROUND, identity, mix, sets

BLOCK_CHARS = 1_000_000
#: log2 of the sketch's counters.
SKETCH_BITS = 18
#: A shingle is frequent when its counter has so many times the mean, and this many at least.
FREQUENT, FREQUENT_LEAST = 3.0, 48
#: Fragments that overlaps are counted in.
COARSE = 4
#: Rounds of new names for buckets of more than ``MANY`` members.
DEEP, MANY = 2, 16384
#: Members of a block, and about as many of small groups in a task.
BLOCK, TOGETHER = 1024, 4096


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def prefix(own: np.ndarray, shared: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that name a set, of those that are ``shared``; ``late``: which are frequent."""
    some = own[shared]
    if not len(some):
        return some
    most = len(own) - -(-percent * len(own) // 100) + 1
    late = late[shared]
    return np.concatenate([some[~late], some[late]])[: max(0, most - (len(own) - len(some)))]


def _sketch(table: DataFrame) -> np.ndarray:
    """Sum of the partitions' counting sketches, in two levels: rows (slot, part, counts) in."""

    def add(pdf):
        total = reduce(np.add, (np.frombuffer(c, "<i8") for c in pdf["counts"]))
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "counts": [total.tobytes()]})

    some = table.groupBy("slot", "part").applyInPandas(add, "slot int, counts binary")
    rows = some.groupBy("slot").applyInPandas(add, "slot int, counts binary").collect()
    size = 1 << SKETCH_BITS
    out = np.zeros(size, np.int64)
    for r in rows:
        own = np.frombuffer(r["counts"], "<i8")
        out[r["slot"] * len(own):(r["slot"] + 1) * len(own)] = own
    return out


def parities(own: np.ndarray) -> bytes:
    """A bit map of the parity of a set's elements by their last bits, of 2 to 4 bits an element. The bits in which two
    such maps differ are no more than the elements in which the sets do."""
    bits = 1 << max(6, int(2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many elements two sets of these parities differ at least; the longer map is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that sizes and parities, of ``marks`` (node, n, parity), don't rule out."""

    def run(batches):
        for batch in batches:
            (na, nb), sides = (batch.column(k).to_numpy() for k in (2, 3)), (batch.column(k).to_pylist() for k in (4, 5))
            most = (100 - percent) * (na + nb) // (100 + percent)
            fine = np.array([apart(x, y) <= m for x, y, m in zip(*sides, most.tolist())], bool)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(fine)) for k in (0, 1)], ["a", "b"])

    left, right = (marks.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _links(near: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs ``near`` (a, b): overlaps are counted by fragment, then summed. ``whole``: (node, fragment, n, hashes)."""
    left = whole.select(F.col("node").alias("a"), "fragment", F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = whole.select(F.col("node").alias("b"), "fragment", F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    cut = near.withColumn("fragment", F.explode(F.array(*[F.lit(i) for i in range(COARSE)])))
    both = cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("part"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    return summed.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def _renamed(rest: DataFrame, whole: DataFrame, common, percent: int, together: int = 256) -> DataFrame:
    """Members (key, node, n, shared) of new buckets for ``rest`` (hub, node, n, component).

    Of two linked sets of different components one at least isn't linked with the hub. Let A and B be what they differ from
    it in: then A and B share len(A) - t elements at least, t being the most in which linked sets of such sizes differ,
    and one at least; so each names itself by its first t + 1. About ``together`` members meet their hub in a task.
    """
    ways = stored(rest.groupBy("hub").agg(F.ceil(F.count("*") / together).cast("int").alias("ways")), "ways")
    left = rest.join(ways, "hub").withColumn("part", F.pmod(F.xxhash64("node"), "ways").cast("int")).join(whole.select("node", "fragment", "hashes"), "node").select("hub", "part", "node", "n", "component", "fragment", "hashes")
    right = ways.join(whole.select(F.col("node").alias("hub"), F.col("fragment").alias("of"), F.col("hashes").alias("of_hub")), "hub")
    right = right.select(F.col("hub").alias("h"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("p"), "of", "of_hub")

    def name(members: pa.Table, hubs: pa.Table) -> pa.Table:
        often = np.unpackbits(common.value[0]).astype(bool)
        keys, nodes, sizes, parts = [], [], [], []
        if len(members) and len(hubs):
            held = {f: h.values.to_numpy().view(np.uint64) for f, h in zip(hubs.column("of").to_pylist(), hubs.column("of_hub"))}
            salt = mix(hubs.column("h").to_numpy()[:1].view(np.uint64), 30)
            node, n, component, fragment = (members.column(k).to_numpy() for k in ("node", "n", "component", "fragment"))
            order = np.lexsort((fragment, node))
            for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                more, less = [], []
                for i in own.tolist():
                    b, a = members.column("hashes")[i].values.to_numpy().view(np.uint64), held[int(fragment[i])]
                    more.append(np.setdiff1d(b, a, True))
                    less.append(np.setdiff1d(a, b, True))
                more, i = np.concatenate(more), own[0]
                late = often[(more >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                most = (100 - percent) * (n[i] + 100 * n[i] // percent) // (100 + percent) + 1
                first = np.concatenate([more[~late], more[late], *less])[:most]
                keys.append(mix(first + salt, 32))
                for out, value in ((nodes, node[i]), (sizes, n[i]), (parts, component[i])):
                    out.append(np.full(len(first), value))
        none = np.zeros(0, np.int64)
        return pa.table({"key": _signed(np.concatenate([none.view(np.uint64), *keys])), **{k: np.concatenate([none, *x]) for k, x in (("node", nodes), ("n", sizes), ("component", parts))}})

    named = stored(left.groupBy("hub", "part").cogroup(right.groupBy("h", "p")).applyInArrow(name, "key long, node long, n long, component long"), "named")
    several = stored(named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"), "several")
    members = stored(named.join(several, "key").select("key", "node", "n").distinct(), "members")
    shared = stored(members.groupBy("node").agg(F.count("*").alias("shared")), "shared")
    out = stored(members.join(shared, "node"), "members")
    discard(ways, named, several, members, shared)
    return out


def close_pairs(n: np.ndarray, component: np.ndarray, side: np.ndarray, parity: list[bytes], percent: int, same: bool):
    """Places (x, y) of the sets that sizes and parities let be linked, of different components; and, unless ``same``, of different sides."""
    order = np.argsort(n, kind="stable")
    n, component, side = n[order], component[order], side[order]
    length = np.array([len(parity[i]) for i in order])
    out = [np.zeros((2, 0), np.int64)]
    for size in np.unique(length):
        mine = np.flatnonzero(length == size)
        bits = np.frombuffer(b"".join(parity[order[i]] for i in mine), np.uint64).reshape(len(mine), -1)
        longer = np.flatnonzero(length == 2 * size)
        wide = np.frombuffer(b"".join(parity[order[i]] for i in longer), np.uint64).reshape(len(longer), -1) if len(longer) else None
        if wide is not None:
            wide = wide[:, : bits.shape[1]] ^ wide[:, bits.shape[1]:]
        top = 100 * n[mine] // percent
        for at, i in enumerate(mine):
            for others, held, first in ((mine, bits, at + 1), (longer, wide, 0)):
                last = int(np.searchsorted(n[others], top[at], "right")) if held is not None else 0
                if last <= first:
                    continue
                j = others[first:last]
                fine = component[j] != component[i]
                if not same:
                    fine &= side[j] != side[i]
                j = j[fine]
                if len(j):
                    far = np.bitwise_count(held[first:last][fine] ^ bits[at]).sum(1, dtype=np.int64)
                    j = j[far <= (100 - percent) * (n[j] + n[i]) // (100 + percent)]
                    out.append(np.stack([np.full(len(j), i), j]))
    return order[np.concatenate(out, axis=1)]


def _in_blocks(rest: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the components that ``rest`` (hub, node, n, component) has around one hub, as far as sizes and parities let them be
    linked. A large group is cut into blocks, each pair of which is a task; small groups share tasks."""
    total = rest.count()
    tasks = max(1, -(-total // TOGETHER))
    ways = stored(rest.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ways")), "ways")
    dealt = rest.join(ways, "hub").join(marks.select("node", "parity"), "node").withColumn("block", F.pmod(F.xxhash64("node"), "ways").cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    dealt = dealt.select("hub", F.when(F.col("ways") > 1, F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(tasks))).alias("task"), F.least("block", "k").alias("x"), F.greatest("block", "k").alias("y"),
                         "block", "node", "n", "component", "parity")

    def compare(group: pa.Table) -> pa.Table:
        hub, node, n, component, block, x, y = (group.column(k).to_numpy() for k in ("hub", "node", "n", "component", "block", "x", "y"))
        parity, out = group.column("parity").to_pylist(), [np.zeros((2, 0), np.int64)]
        order = np.argsort(hub, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(hub[order])) + 1):
            if len(own) > 1:
                i, j = close_pairs(n[own], component[own], block[own], [parity[k] for k in own], percent, x[own[0]] == y[own[0]])
                out.append(np.sort(np.stack([node[own[i]], node[own[j]]]), axis=0))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": a, "b": b})

    near = stored(dealt.groupBy("task", "x", "y").applyInArrow(compare, "a long, b long").distinct(), "near")
    discard(ways)
    return near


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, deep: int = DEEP, many: int = MANY, name_bits: int = 64) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than ``words``
    words is one shingle, one without words has an empty set and is linked with nothing
    (null counts as empty). Sets are linked when 100 * common >= percent * union. The
    component is the smallest key reachable. Rows of one key are one document; rows with a
    null key are linked with nothing and have a null component. Texts are read whole, however long. Shingles are compared by
    64-bit hashes; sets are named by ``name_bits`` bits, and by 64 more where different sets have one
    name. Only ``key`` and ``text`` are read, whatever the names of others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("id"), text_column(docs, text).cast("binary").alias("text"))
    slots = 64

    id_type = to_arrow_type(docs.schema[key].dataType)

    def measure(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["id", "n", "node", "check", "slot", "counts"]
        for part, texts in blocks(batches, 1, BLOCK_CHARS):
            hashes, offsets = sets(texts, words)
            counts += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            n = np.diff(offsets)
            node, check = identity(hashes, offsets, name_bits)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(_signed(node)), pa.array(_signed(check)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if counts.any():
            none = pa.nulls(slots, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(slots, id_type), none, none, none, pa.array(range(slots), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, slots)], pa.binary())], names)

    measured = stored(source.mapInArrow(measure, f"id {kind}, n long, node long, check long, slot int, counts binary"), "sets")
    table = measured.where("slot is null").select("id", "n", "node", "check")
    # names that different sets share: next to none of 64 bits
    shared_names = {r["node"] for r in table.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b").select("node").toLocalIterator()}
    twice = np.array(sorted(shared_names), np.int64).view(np.uint64)

    def told(hashes, offsets):
        node, check = identity(hashes, offsets, name_bits)
        return np.where(np.isin(node, twice), mix(node + check, 28), node) if len(twice) else node

    if len(twice):  # the same in the table
        def rename(batches):
            for batch in batches:
                node, check = (batch.column(k).to_numpy().view(np.uint64) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_signed(np.where(np.isin(node, twice), mix(node + check, 28), node)))], ["id", "n", "node"])

        table = stored(table.mapInArrow(rename, f"id {kind}, n long, node long"), "renamed")
    table = table.select("id", "n", "node")
    sketch = _sketch(measured.where("slot is not null").select("slot", "counts", F.pmod(F.spark_partition_id(), F.lit(8)).alias("part")))
    limit = max(FREQUENT_LEAST, FREQUENT * sketch.mean())
    common = spark.sparkContext.broadcast((np.packbits(sketch >= limit),))  # one bit a counter: 32 KB

    def name(batches):
        for _, texts in blocks(batches, 0, BLOCK_CHARS):
            hashes, _ = sets(texts, words)
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(hashes))], ["key"])

    # the shingles that several texts have; those of copies only are among them, which does no harm
    several = stored(source.select("text").mapInArrow(name, "key long").groupBy("key").count().where("count > 1").select("key"), "several")
    passing = spark.sparkContext.broadcast(bitmap(several))

    def take(batches):
        held, bits = passing.value
        often = np.unpackbits(common.value[0]).astype(bool)
        for _, texts in blocks(batches, 0, BLOCK_CHARS):
            hashes, offsets = sets(texts, words)
            nodes, shared = told(hashes, offsets), among(held, bits, hashes)
            late = often[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            names = [prefix(hashes[a:b], shared[a:b], late[a:b], percent) for a, b in zip(offsets, offsets[1:])]
            count = np.fromiter(map(len, names), np.int64, len(names))
            if count.any():
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(names))), pa.array(_signed(np.repeat(nodes, count))), pa.array(np.repeat(np.diff(offsets), count))], ["key", "node", "n"])

    # equal texts name the same rows, which are one from here on
    taken = stored(source.select("text").mapInArrow(take, "key long, node long, n long").distinct(), "candidates")
    members = stored(taken.join(several, "key"), "members")
    nodes = stored(members.groupBy("node", "n").agg(F.count("*").alias("shared")), "nodes")
    plain, members = members, stored(members.drop("n").join(nodes, "node"), "members")
    discard(taken, several, plain)
    wanted = spark.sparkContext.broadcast(bitmap(nodes.select(F.col("node").alias("key"))))

    edges = np.arange(1, COARSE, dtype=np.uint64) * np.uint64((1 << 64) // COARSE)

    def fetch(batches):
        held, bits = wanted.value
        for part, texts in blocks(batches, 1, BLOCK_CHARS):
            hashes, offsets = sets(texts, words)
            own = told(hashes, offsets)
            hit = np.flatnonzero(among(held, bits, own) & (np.diff(offsets) > 0))
            if not len(hit):
                continue
            each = [hashes[offsets[i]:offsets[i + 1]] for i in hit]
            cut = [f for h in each for f in np.split(_signed(h), np.searchsorted(h, edges))]
            again = np.repeat(np.arange(len(hit)), COARSE)
            marks = [parities(h) if k == 0 else None for h in each for k in range(COARSE)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(hit[again])), pa.array(_signed(own[hit])[again]), pa.array(np.diff(offsets)[hit][again]), pa.array(np.tile(np.arange(COARSE, dtype=np.int32), len(hit))),
                 pa.array(cut, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["row", "node", "n", "fragment", "hashes", "parity"])

    rows = source.select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(fetch, "row long, node long, n long, fragment int, hashes array<long>, parity binary")
    sets_ = stored(rows, "found")
    first = stored(sets_.where("fragment = 0").select("node", "row").join(nodes.select("node"), "node").groupBy("node").agg(F.min("row").alias("row")).select("row"), "first")
    whole = stored(sets_.join(first, "row", "left_semi").drop("row"), "fragments")
    marks = stored(whole.where("fragment = 0").select("node", "n", "parity"), "marks")
    discard(sets_)

    ids = table.where("id is not null and n > 0")
    # documents that appear with several sets
    double = ids.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    links = stored(ids.join(stored(double, "double"), "id").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "links")
    for step in range(deep + 1):
        hubs = (members.groupBy("key").agg(F.max(F.struct(F.col("shared") / F.col("n"), F.col("node"))).alias("m"), F.count("*").alias("size"))
                .where("size > 1").select("key", F.col("m.node").alias("hub")))
        hubs = stored(hubs, "hubs")
        starred = members.join(hubs, "key").where("node <> hub")
        pairs = starred.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        near = stored(_near(pairs, marks, percent), "near")
        before, links = links, stored(links.union(_links(near, whole, percent)), "links")
        discard(before, near)
        groups = stored(components(links), "groups")
        # buckets that still hold more than one component
        placed = stored(members.join(groups, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
        open_ = placed.join(hubs, "key").where("node <> hub").groupBy("key", "hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key", "hub")
        rest = stored(placed.join(open_, "key").where("node <> hub").select("hub", "node", "n", "component").distinct(), "rest")
        discard(members, placed, hubs)
        if not rest.limit(1).count():
            break
        large = stored(rest.groupBy("hub").count().where(F.col("count") > many).select("hub"), "large") if step < deep else rest.where("false").select("hub")
        near = _in_blocks(rest.join(large, "hub", "left_anti"), marks, percent)
        before, links = links, stored(links.union(_links(near, whole, percent)), "links")
        discard(before, near)
        if not large.limit(1).count():
            groups = stored(components(links), "groups")
            break
        members = _renamed(rest.join(large, "hub", "left_semi"), whole, common, percent)
        discard(rest, large)
    discard(whole, marks)

    least = stored(ids.groupBy("node").agg(F.min("id").alias("least")), "least")
    grouped = stored(groups.join(least, "node").select("node", "component", "least"), "groups")
    reached = stored(grouped.groupBy("component").agg(F.min("least").alias("reached")), "reached")
    better = stored(grouped.join(reached, "component").select("node", "reached"), "better")
    final = stored(least.join(better, "node", "left").select("node", F.coalesce("reached", "least").alias("component_id")), "final")
    nodes = table.where("id is not null and n > 0").join(final, "node").select("id", "n", "component_id")
    others = table.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    return nodes.union(others).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
