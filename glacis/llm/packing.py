"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids, ids become pieces of at most ``capacity`` tokens, and
pieces are dealt by hash into demes of bounded size. Each deme is packed on several
islands: an island starts from random packings, crossover injects whole well-filled
bins of one parent into the other, bins that hold a piece twice are dissolved,
and the displaced pieces are placed by best fit. Between epochs the elite packing of
each island goes to the next one. A deme rests once a packing of it
reaches the lower bound, as no packing is better.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks, byte_letters
from .common import discard, stored, text_column

#: The split pattern of byte-level BPE (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a block of texts.
BLOCK_CHARS = 1_000_000
#: Shares of the bins beside the injected ones that crossovers dissolve, the emptiest first, in turn.
DISSOLVED = (0.05, 0.3, 0.6)
#: The special token of the vocabulary: where a text holds it, it is one token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class ByteBPE:
    """Ids of a byte-level BPE: ``path`` is a file of ranks, or one of vocabulary and merges (``.json``)."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            byte_of = {letter: b for b, letter in enumerate(byte_letters())}
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t != SPECIAL}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if SPECIAL in text:
            return SPECIAL_ID.to_bytes(4, "little").join(self.ids(t) for t in text.split(SPECIAL))
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


_LOADED: dict[str, ByteBPE] = {}


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, carry_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the ids of each whole text and a
    final 0, cut into pieces of ``capacity`` where longer; the first piece is the shorter one."""

    def run(batches):
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = ByteBPE(tokenizer)
        encode, end = _LOADED[tokenizer].ids, b"\0\0\0\0"
        for part, texts in blocks(batches, 1, BLOCK_CHARS):
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, t in enumerate(texts):
                ids = encode(t) + end
                n = len(ids) // 4
                at, size = 0, n % capacity or min(n, capacity)
                j = 0
                while at < n:
                    own = ids[4 * at:4 * (at + size)]
                    row.append(i)
                    piece.append(j)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    if carry_ids:
                        held.append(own)
                    at, size, j = at + size, capacity, j + 1
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if carry_ids:
                columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("id"), text_column(docs, text).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * carry_ids)


class Bins:
    """Open bins by the room that is left, for best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, [], {}

    def add(self, room: int, one: list[int]) -> None:
        if room in self.by_room:
            self.by_room[room].append(one)
        else:
            self.by_room[room] = [one]
            bisect.insort(self.rooms, room)

    def place(self, item: int, size: int) -> None:
        """Into the fullest bin that has the room, or a new one."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            self.add(self.capacity - size, [item])
            return
        room = self.rooms[i]
        held = self.by_room[room]
        one = held.pop()
        if not held:
            del self.by_room[room], self.rooms[i]
        one.append(item)
        self.add(room - size, one)

    def all(self) -> list[list[int]]:
        return [one for room in self.rooms for one in self.by_room[room]]


def best_fit(order, sizes: list[int], capacity: int, bins=()) -> list[list[int]]:
    """``bins`` with the items of ``order`` placed one after the other."""
    state = Bins(capacity)
    for one in bins:
        state.add(capacity - sum(map(sizes.__getitem__, one)), list(one))
    for i in order:
        state.place(i, sizes[i])
    return state.all()


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng, dissolved: float = 0.3) -> list[list[int]]:
    """Whole bins of ``b``, the fuller ones likelier, injected into ``a``.

    Bins of ``a`` that hold a piece of them are removed, and so is the given share of the emptiest of the rest;
    the pieces that are displaced go, the longest first, where they fit best.
    """
    fill = np.fromiter((sum(map(sizes.__getitem__, one)) for one in b), np.float64, len(b)) / capacity
    chance = fill ** 8
    picked = np.flatnonzero(rng.random(len(b)) < rng.uniform(0.1, 0.5) * chance / max(chance.mean(), 1e-9))
    injected = [b[i] for i in picked]
    twice = {i for one in injected for i in one}
    kept, displaced = [], []
    for one in a:
        if twice.isdisjoint(one):
            kept.append(one)
        else:
            displaced += [i for i in one if i not in twice]
    load = [sum(map(sizes.__getitem__, one)) for one in kept]
    for i in sorted(range(len(kept)), key=load.__getitem__)[: max(1, int(len(kept) * dissolved))] if kept else []:
        displaced += kept[i]
        kept[i] = None
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, injected + [one for one in kept if one is not None])


def fitness(bins: list[list[int]], sizes: list[int], capacity: int):
    """Fewest bins first, then fuller ones: the mean of the squared fills."""
    return -len(bins), sum((sum(map(sizes.__getitem__, one)) / capacity) ** 2 for one in bins) / max(len(bins), 1)


def evolve(sizes: list[int], capacity: int, seed: int, elites=(), population: int = 4, generations: int = 12) -> tuple[list[list[int]], int]:
    """One island's epoch: the best packing it finds, and how many crossovers it took.

    Without ``elites`` the population is grown at random: pieces placed in any order, far from the bound.
    Crossover does the rest. It ends at the lower bound, as no packing is better, or after so many ``generations``
    (few pieces get more of them).
    """
    bound = -(-sum(sizes) // capacity)
    rng = np.random.default_rng(seed)
    generations = max(generations, min(400, 40_000 // max(len(sizes), 1)))
    pool = [list(e) for e in elites]
    while len(pool) < population and min(map(len, pool), default=bound + 1) > bound:
        pool.append(best_fit(rng.permutation(len(sizes)).tolist(), sizes, capacity))
    score = lambda one: fitness(one, sizes, capacity)
    ranked = sorted(((score(one), -i, one) for i, one in enumerate(pool)), reverse=True)
    made = 0
    while len(ranked[0][2]) > bound and made < 2 * generations:
        a, b = rng.permutation(len(ranked))[:2]
        for x, y in ((a, b), (b, a)):
            made += 1
            child = crossover(ranked[x][2], ranked[y][2], sizes, capacity, rng, DISSOLVED[made % 3])
            got = score(child)
            if all(got != s for s, _, _ in ranked):  # a twin adds nothing
                ranked.append((got, -len(pool) - made, child))
        ranked.sort(key=lambda r: r[:2], reverse=True)
        del ranked[population:]
    return ranked[0][2], made


def _epoch(frame: DataFrame, capacity: int, islands: int, epoch: int) -> DataFrame:
    """Rows (deme, island, uid, length, home, bin) in, home naming the island whose elite the bin is
    of (-1: none yet); the island's best packing out."""

    def run(key, pdf):
        deme, island = map(int, key)
        items = pdf.drop_duplicates("uid").sort_values("uid", kind="stable")
        sizes = items["length"].tolist()
        number = {u: i for i, u in enumerate(items["uid"].tolist())}
        elites = []
        for home, own in pdf.groupby("home"):
            if home >= 0:
                elites.append([[number[u] for u in g.tolist()] for _, g in own["uid"].groupby(own["bin"])])
        best, made = evolve(sizes, capacity, 1_000_003 * deme + 101 * island + epoch, elites)
        bin_of = np.empty(len(sizes), np.int64)
        for b, one in enumerate(best):
            bin_of[one] = b
        return pd.DataFrame({"deme": deme, "island": island, "uid": items["uid"].to_numpy(), "length": items["length"].to_numpy(), "home": island, "bin": bin_of,
                             "bins": len(best), "bound": -(-sum(sizes) // capacity), "made": made})

    return frame.groupBy("deme", "island").applyInPandas(run, "deme long, island int, uid long, length long, home int, bin long, bins long, bound long, made long")


def islands_of(table: DataFrame, capacity: int = 2048, deme: int = 8192, islands: int = 2, epochs: int = 3) -> DataFrame:
    """The packings of all islands after the last epoch: rows (deme, island, uid, length, home, bin, bins, bound, made).

    ``table`` has ``uid`` and ``length`` below ``capacity``. In each epoch an island is joined by the elite of the one
    before; where one of them is at the deme's bound it stays as it is.
    """
    demes = max(1, -(-table.count() // deme))
    start = (table.withColumn("deme", F.pmod(F.xxhash64("uid"), F.lit(demes)))
             .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
             .select("deme", "island", "uid", "length", F.lit(-1).alias("home"), F.lit(0).cast("long").alias("bin")))
    state = stored(_epoch(start, capacity, islands, 0), "elites")
    columns = ["deme", "island", "uid", "length", "home", "bin"]
    for epoch in range(1, epochs):
        if not state.groupBy("deme").agg(F.min("bins").alias("least"), F.min("bound").alias("low")).where("least > low").limit(1).count():
            break
        guests = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        before, state = state, stored(_epoch(state.select(*columns).union(guests.select(*columns)), capacity, islands, epoch), "elites")
        discard(before)
    return state


def pack(table: DataFrame, capacity: int = 2048, deme: int = 8192, islands: int = 2, epochs: int = 3) -> DataFrame:
    """``table`` has ``uid`` (unique) and ``length`` (1 to ``capacity``); rows (uid, sequence_id, offset).

    Pieces that fill a sequence have it for themselves. ``deme`` bounds what one
    task holds; demes are dealt by hash of uid, so equal keys don't meet in one.
    """
    full = table.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = islands_of(table.where(F.col("length") < capacity), capacity, deme, islands, epochs)
    best = state.groupBy("deme", "island").agg(F.min("bins").alias("bins")).groupBy("deme").agg(F.min(F.struct("bins", "island")).alias("m"))
    best = stored(best.select("deme", F.col("m.island").alias("island")), "best")
    chosen = state.join(best, ["deme", "island"]).withColumn("sequence_id", F.col("deme") * F.lit(1 << 20) + F.col("bin"))
    inside = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = chosen.select("uid", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    return placed.union(full)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of the vocabulary or rank file on the executors. A null text is
    empty (one piece, the final 0); repeated rows and null keys are packed like
    others; texts of any length are cut into pieces. Only ``key`` and ``text`` are read, whatever the names of
    others. An empty table gives no rows.
    """
    table = stored(pieces(docs, tokenizer, key, text, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = stored(pack(table.select("uid", "length"), capacity), "placed")
    return table.join(placed, "uid").select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
