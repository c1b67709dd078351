"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Equal vectors are one vector with a weight first. The top of the tree is distributed: vectors of one
length are a cell, and a cell of too many is split around centres picked from a sample of it, those
cells again, and so on, until each is a block of bounded size. A block gets a
cover tree: nested levels of radius 2, 1, 1/2, ..., every centre being a centre of all deeper
levels too. The traversal starts with pairs of whole cells, level by level by equal joins, and goes on inside
pairs of blocks, one a task: a pair of nodes is dropped when their covering radii
can't bring members within the threshold, taken whole when they can't keep members
apart, and opened otherwise. Where few pairs of nodes can be dropped, the next
level's distances are computed as one product of matrices instead of pair by pair.

Links inside a group of near copies are thus counted without listing them, and
each task returns a count and the smallest neighbour's group for a vector, not pairs.

Vectors without any structure (far apart in many dimensions) let no bound drop anything above single
vectors: blocks then all meet, and the work is that of a blocked product of all with all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stored

#: Deepest level (radius 2 / 2^LEVELS), and the slack that rounding of a distance needs.
LEVELS, SLACK = 6, 1e-7
#: What rounding of a product in single precision may add to a cosine.
COARSE = 1e-5
#: Vectors in a block at most, and numbers in it (wide vectors have smaller blocks).
BLOCK, NUMBERS = 8192, 1 << 22
#: Parts of a cell at most; vectors that their centres are picked from, about; cells whose centres are broadcast together.
CENTRES, SAMPLE, TOGETHER = 256, 4096, 64
STRIP = 512


def most_in_block(width: int) -> int:
    return int(np.clip(NUMBERS // max(width, 1), 64, BLOCK))


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    scale = np.abs(raw).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    raw = raw / np.where(scale > 0, scale, 1)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """Centres for the top level: the farthest point from those taken, again and again."""
    taken = [0]
    far = 2 - 2 * points @ points[0]
    while len(taken) < min(most, len(points)):
        i = int(np.argmax(far))
        if far[i] <= 1e-12:
            break
        taken.append(i)
        far = np.minimum(far, 2 - 2 * points @ points[i])
    return points[taken]


def build(points: np.ndarray) -> np.ndarray:
    """The tree as one row of centres for each point: its node at levels 0 to LEVELS."""
    n = len(points)
    path = np.zeros((LEVELS + 1, n), np.int32)
    groups = [np.arange(n)]  # members of each node, the centre first
    for level in range(1, LEVELS + 1):
        near = 1 - (2.0 / 2**level) ** 2 / 2  # cosine at the level's radius
        deeper = []
        for members in groups:
            if len(members) == 1:
                path[level:, members] = members[0]
                continue
            rest = members
            while len(rest):
                # those first in line are centres, unless one before covers them
                close = points[rest] @ points[rest[:STRIP]].T >= near
                free = np.ones(len(rest), bool)
                for i in range(close.shape[1]):
                    if free[i]:
                        own = free & close[:, i]
                        own[i] = True
                        free &= ~own
                        own = rest[own]
                        path[level, own] = rest[i]
                        deeper.append(np.concatenate([[rest[i]], own[own != rest[i]]]))
                rest = rest[free]
        groups = deeper
    return path


class Tree:
    """A block's vectors in depth-first order, and its nodes by level as ranges of them."""

    def __init__(self, points: np.ndarray, path: np.ndarray, weights: np.ndarray):
        self.order = np.lexsort(path[::-1])
        self.points, self.weights = points[self.order], weights[self.order]
        self.below = np.concatenate([[0], np.cumsum(self.weights)])
        path = path[:, self.order]
        where = np.empty(len(self.order), np.int64)
        where[self.order] = np.arange(len(self.order))
        self.first, self.size, self.centre, self.radius, self.child = [], [], [], [], []
        for level in path:
            first = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            size = np.diff(np.append(first, len(level)))
            centre = where[level[first]]
            gap = np.einsum("ij,ij->i", self.points, self.points[np.repeat(centre, size)])
            away = np.sqrt(np.maximum(2 - 2 * np.minimum.reduceat(gap, first), 0))
            away[size == 1] = 0
            self.first.append(first)
            self.size.append(size)
            self.centre.append(centre)
            self.radius.append(away)
        for a, b in zip(self.first, self.first[1:]):
            self.child.append(np.searchsorted(b, np.append(a, len(self.points))))

    def weight(self, level: int, nodes: np.ndarray) -> np.ndarray:
        first = self.first[level][nodes]
        return self.below[first + self.size[level][nodes]] - self.below[first]


def _pairs_of_ranges(a0, an, b0, bn):
    """All (x, y) with x in the i-th range of a and y in the i-th of b."""
    n = an * bn
    i = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[i] + at // bn[i], b0[i] + at % bn[i]


def traverse(a: Tree, b: Tree, cosine: float, same: bool):
    """(links of a's vectors, links of b's, edges): links go by the weights of the vectors linked with, edges are pairs of
    places that join what is linked; ``same``: both are one block, whose pairs count once."""
    eps = np.sqrt(2 - 2 * cosine)
    add_a, add_b = np.zeros(len(a.points) + 1, np.int64), np.zeros(len(b.points) + 1, np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def take(x, y):  # single links
        for add, at, got in ((add_a, x, b.weights[y]), (add_b, y, a.weights[x])):
            np.add.at(add, at, got), np.add.at(add, at + 1, -got)
        edges.append((x, y))

    def whole(level, i, j):  # every member of i with every member of j
        own = (i == j) if same else np.zeros(len(i), bool)
        for mine, add, tree, other, from_ in ((i, add_a, a, j, b), (j, add_b, b, i, a)):
            if same and add is add_b:
                mine, other = mine[~own], other[~own]
            first, size = tree.first[level][mine], tree.size[level][mine]
            got = from_.weight(level, other)
            np.add.at(add, first, got)
            np.add.at(add, first + size, -got)
        if own.any():  # but itself
            x, _ = _pairs_of_ranges(a.first[level][i[own]], a.size[level][i[own]], np.zeros(own.sum(), np.int64), np.ones(own.sum(), np.int64))
            np.add.at(add_a, x, -a.weights[x]), np.add.at(add_a, x + 1, a.weights[x])
        ca, cb = a.centre[level][i], b.centre[level][j]
        sa, sb = a.size[level][i], b.size[level][j]
        x, _ = _pairs_of_ranges(a.first[level][i], sa, np.zeros_like(sa), np.ones_like(sa))
        edges.append((x, np.repeat(cb, sa)))
        y, _ = _pairs_of_ranges(b.first[level][j], sb, np.zeros_like(sb), np.ones_like(sb))
        edges.append((np.repeat(ca, sb), y))

    def sift(level, i, j):
        """Decide the pairs of nodes that can be decided; the rest is returned."""
        dot = np.einsum("ij,ij->i", a.points[a.centre[level][i]], b.points[b.centre[level][j]])
        ra, rb = a.radius[level][i], b.radius[level][j]
        single = (a.size[level][i] == 1) & (b.size[level][j] == 1)
        d = np.sqrt(np.maximum(2 - 2 * dot, 0))
        link = single & (dot >= cosine)
        if same:
            link &= i != j
        if link.any():
            take(a.first[level][i[link]], b.first[level][j[link]])
        full = ~single & (d + ra + rb <= eps - SLACK)
        if full.any():
            whole(level, i[full], j[full])
        left = ~single & ~full & (d <= ra + rb + eps + SLACK)
        return i[left], j[left]

    def sift_all(level, open_):
        """The same for a matrix of open pairs (None: all), by products of matrices in single precision, whose
        rounding COARSE covers; what they can't tell is computed anew. Nodes of one vector only need the threshold."""
        ca, cb = a.points[a.centre[level]].astype(np.float32), b.points[b.centre[level]].astype(np.float32)
        ra, rb = a.radius[level].astype(np.float32), b.radius[level].astype(np.float32)
        single_a, single_b = (np.flatnonzero(t.size[level] == 1) for t in (a, b))
        several_a, several_b = (np.flatnonzero(t.size[level] > 1) for t in (a, b))
        out = np.zeros((len(ca), len(cb)), bool)

        def products(rows, columns):
            right = cb[columns].T
            for s in range(0, len(rows), STRIP):
                yield rows[s:s + STRIP], ca[rows[s:s + STRIP]] @ right

        for rows, g in products(single_a, single_b) if len(single_b) else ():
            if same:
                g[rows[:, None] >= single_b[None]] = -1
            hot = np.flatnonzero(g.max(1) >= cosine - COARSE)
            x, y = np.nonzero(g[hot] >= cosine - COARSE)
            i, j = rows[hot[x]], single_b[y]
            if open_ is not None and len(i):
                fine = open_[i, j]
                i, j = i[fine], j[fine]
            if len(i):
                sift(level, i, j)
        for some, columns in ((several_a, np.arange(len(cb))), (single_a, several_b)):
            for rows, g in products(some, columns) if len(columns) else ():
                reach = ra[rows, None] + (rb[columns] + np.float32(eps))[None]
                near = g >= 1 - reach * reach / 2 - np.float32(COARSE)
                if open_ is not None:
                    near &= open_[np.ix_(rows, columns)]
                if same:
                    near &= rows[:, None] <= columns[None]
                inner = np.float32(eps) - (reach - np.float32(eps)) + np.float32(1e-3)
                x, y = np.nonzero(near & (inner > 0) & (g >= 1 - inner * inner / 2 - np.float32(COARSE)))
                if len(x):  # perhaps whole: told apart in double precision
                    near[x, y] = False
                    i, j = sift(level, rows[x], columns[y])
                    out[i, j] = True
                x, y = np.nonzero(near)
                out[rows[x], columns[y]] = True
        return out

    i, j, matrix, every = np.zeros(1, np.int64), np.zeros(1, np.int64), None, np.ones((1, 1), bool)
    for level in range(LEVELS + 1):
        if matrix is not None:
            if matrix is not every and not matrix.any():
                matrix = None
                i = j = np.zeros(0, np.int64)
                break
            matrix = sift_all(level, None if matrix is every else matrix)
            if matrix.sum() <= 0.005 * matrix.size:
                i, j = np.nonzero(matrix)
                matrix = None
        else:
            if not len(i):
                break
            got = [sift(level, i[c:c + 200_000], j[c:c + 200_000]) for c in range(0, len(i), 200_000)]
            i, j = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        if level == LEVELS:
            break
        from_a, from_b = a.child[level], b.child[level]
        na, nb = np.diff(from_a), np.diff(from_b)
        if matrix is None and (na[i] * nb[j]).sum() > 0.005 * na.sum() * nb.sum() and na.sum() * nb.sum() > 4096:
            # many pairs of the next level are open: as a matrix, and one product for all
            matrix = np.zeros((len(na), len(nb)), bool)
            matrix[i, j] = True
        if matrix is not None:
            matrix = every if matrix.all() else np.repeat(np.repeat(matrix, na, axis=0), nb, axis=1)
        else:
            i, j = _pairs_of_ranges(from_a[i], na[i], from_b[j], nb[j])
            if same:
                i, j = i[i <= j], j[i <= j]
    if matrix is not None:
        i, j = np.nonzero(matrix)
    for c in range(len(i)):  # pairs of deepest nodes about the threshold: member by member
        ra = slice(a.first[LEVELS][i[c]], a.first[LEVELS][i[c]] + a.size[LEVELS][i[c]])
        rb = slice(b.first[LEVELS][j[c]], b.first[LEVELS][j[c]] + b.size[LEVELS][j[c]])
        for s in range(ra.start, ra.stop, STRIP):
            for t in range(rb.start, rb.stop, STRIP):
                x, y = np.nonzero(a.points[s:min(s + STRIP, ra.stop)] @ b.points[t:min(t + STRIP, rb.stop)].T >= cosine)
                x, y = s + x, t + y
                if same and i[c] == j[c]:
                    x, y = x[x < y], y[x < y]
                take(x, y)
    counts = np.cumsum(add_a[:-1]), np.cumsum(add_b[:-1])
    if same:
        counts = (counts[0] + counts[1],) * 2
    none = np.zeros(0, np.int64)
    return *counts, (np.concatenate([e[0] for e in edges] or [none]), np.concatenate([e[1] for e in edges] or [none]))


def lowest(n: int, x: np.ndarray, y: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name in each place's component."""
    low = names.copy()
    while True:
        before = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        if (before == low).all():
            return low


def _points(column) -> np.ndarray:
    """Vectors of one length that are held as bytes."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _cells(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, cells) of ``points`` (uid, weight, width, point): members have ``cell``; cells (cell, parent, leaf, n, r, centre).

    A cell's name lists the parts that led to it. Its radius ``r`` is that of its members about its centre; the
    first cell of each length has none and covers all.
    """
    spark = points.sparkSession
    state = points.select(F.col("width").cast("string").alias("cell"), "uid", "weight", "width", "point", F.lit(2.0).alias("away"), F.lit(None).cast("binary").alias("centre"), F.lit(1 << 62).alias("up"))
    kept, known = [], []
    while True:
        of = stored(state.groupBy("cell", "width").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.max("centre").alias("centre"), F.max("up").alias("up")), "cells")
        big = (F.col("n") > F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.expr(f"{NUMBERS} div width")))) & (F.col("r") > 1e-5) & (F.col("n") < F.col("up"))
        known.append(of.select("cell", F.expr("if(instr(cell, '/') > 0, substring_index(cell, '/', size(split(cell, '/')) - 1), null)").alias("parent"), (~big).alias("leaf"), "n", "r", "centre"))
        large = stored(of.where(big).select("cell", "n"), "large")
        if not large.limit(1).count():
            kept.append(state)
            break
        kept.append(state.join(large.select("cell"), "cell", "left_anti"))

        def pick(pdf):
            got = _points(pdf["point"])
            width = got.shape[1]
            tops = spread(got, int(np.clip(2 * int(pdf["n"].iloc[0]) // most_in_block(width), 2, CENTRES)))
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "width": [width], "n": pdf["n"].iloc[:1], "tops": [tops.tobytes()]})

        some = state.join(large, "cell").where(F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / SAMPLE).cast("long")) == 0)
        tops = stored(some.select("cell", "n", "point").groupBy("cell").applyInPandas(pick, "cell string, width long, n long, tops binary"), "tops")
        parts, held = [], []

        def deal(held):
            shared = spark.sparkContext.broadcast({r["cell"]: (np.frombuffer(r["tops"], np.float64).reshape(-1, r["width"]), r["n"]) for r in held})  # TOGETHER cells

            def run(batches):
                for pdf in batches:
                    for cell, own in pdf.groupby("cell"):
                        (tops, n), got = shared.value[cell], _points(own["point"])
                        dots = got @ tops.T
                        at = dots.argmax(1)
                        yield pd.DataFrame({"cell": [f"{cell}/{k}" for k in at], "uid": own["uid"].to_numpy(), "weight": own["weight"].to_numpy(), "width": own["width"].to_numpy(), "point": own["point"].to_numpy(),
                                            "away": np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(at)), at], 0)), "centre": [tops[k].tobytes() for k in at], "up": n})

            rows = state.where(F.col("cell").isin([r["cell"] for r in held])).select("cell", "uid", "weight", "width", "point")
            return stored(rows.mapInPandas(run, "cell string, uid long, weight long, width long, point binary, away double, centre binary, up long"), "dealt")

        for r in tops.toLocalIterator():
            held.append(r)
            if len(held) == TOGETHER:
                parts.append(deal(held))
                held = []
        if held:
            parts.append(deal(held))
        state = parts[0]
        for p in parts[1:]:
            state = state.union(p)
    members, cells = kept[0], known[0]
    for m, c in zip(kept[1:], known[1:]):
        members, cells = members.union(m), cells.union(c)
    return members.select("cell", "uid", "weight", "point"), stored(cells, "tree")


def _cell_pairs(cells: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(open, whole): pairs (x, y) of leaf cells, x <= y, by a traversal from the top. Pairs that are too far apart are dropped."""
    eps = float(np.sqrt(2 - 2 * cosine))

    def judge(batches):
        for pdf in batches:
            some = pdf["ca"].notna() & pdf["cb"].notna()
            d = np.zeros(len(pdf))
            for size, own in pdf[some].groupby(pdf[some]["ca"].map(len)):
                d[own.index] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", _points(own["ca"]), _points(own["cb"])), 0))
            reach = pdf["ra"].to_numpy() + pdf["rb"].to_numpy()
            d[(pdf["x"] == pdf["y"]).to_numpy()] = 0
            kind = np.where(some & (d + reach <= eps - SLACK), "whole", np.where(~some | (d <= reach + eps + SLACK), "open", "far"))
            out = pdf[["x", "y", "lx", "ly"]].assign(kind=kind)
            yield out[kind != "far"]

    a = cells.select(F.col("cell").alias("x"), F.col("parent").alias("px"), F.col("leaf").alias("lx"), F.col("r").alias("ra"), F.col("centre").alias("ca"))
    b = cells.select(F.col("cell").alias("y"), F.col("parent").alias("py"), F.col("leaf").alias("ly"), F.col("r").alias("rb"), F.col("centre").alias("cb"))
    schema = "x string, y string, lx boolean, ly boolean, kind string"
    done, whole = [], []
    top = a.where("px is null").join(b, F.col("x") == F.col("y")).select("x", "y", "lx", "ly", "ra", "rb", "ca", "cb")
    going = stored(top.mapInPandas(judge, schema), "pairs")
    while True:
        whole.append(going.where("kind = 'whole'").select("x", "y"))
        done.append(going.where("kind = 'open' and lx and ly").select("x", "y"))
        deeper = going.where("kind = 'open' and not (lx and ly)").select("x", "y", "lx", "ly")
        if not deeper.limit(1).count():
            break
        # a leaf stays itself while the other side is opened
        left = a.select(F.col("px").alias("up"), "x", "lx", "ra", "ca").where("up is not null").union(a.where("lx").select("x", "x", "lx", "ra", "ca"))
        right = b.select(F.col("py").alias("up"), "y", "ly", "rb", "cb").where("up is not null").union(b.where("ly").select("y", "y", "ly", "rb", "cb"))
        next_ = deeper.select(F.col("x").alias("ux"), F.col("y").alias("uy")).join(left.withColumnRenamed("up", "ux"), "ux").join(right.withColumnRenamed("up", "uy"), "uy")
        # within one cell each pair of parts once
        next_ = next_.where("ux <> uy or x <= y").select("x", "y", "lx", "ly", "ra", "rb", "ca", "cb")
        going = stored(next_.mapInPandas(judge, schema), "pairs")
    join = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(join(parts[1:]))
    order = lambda p: p.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return stored(order(join(done)), "open"), stored(order(join(whole)), "whole")


def near_components(table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Two rows are linked when the cosine of their vectors, in double precision, is ``cosine``
    or more. Vectors that are null, empty or zero, or that hold null or non-finite numbers,
    are linked with nothing; vectors of different lengths are never linked with each other.
    ``component_id`` is the smallest key among the rows reachable (null keys aside); repeated
    rows are rows of their own and count as linked. Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    v = table[vector]
    rows = table.select(table[key].alias("id"), v.cast("array<double>").alias("v"))
    rows = rows.withColumn("fine", F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                                              & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # equal vectors are one; what they weigh is how many rows they stand for
    one = rows.where("fine").groupBy("v").agg(F.min("uid").alias("uid"), F.count("*").alias("weight"), F.min("id").alias("least"))
    one = stored(one, "distinct")

    def scale(batches):
        for batch in batches:
            width = batch.column(2).to_numpy()
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(width)])
            out = [None] * len(width)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for i, p in zip(at, unit(flat[(first[at][:, None] + np.arange(w)).ravel()].reshape(-1, w))):
                    out[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["uid", "weight", "width", "point"])

    points = one.select("uid", "weight", F.size("v").cast("long").alias("width"), "v").mapInArrow(scale, "uid long, weight long, width long, point binary")
    members, cells = _cells(stored(points, "points"))
    open_, whole = _cell_pairs(cells, cosine)

    def grow(pdf):
        pdf = pdf.sort_values("uid", ignore_index=True)
        path = build(_points(pdf["point"]))
        return pd.DataFrame({"block": pdf["block"], "uid": pdf["uid"], "weight": pdf["weight"], "place": np.arange(len(pdf), dtype=np.int32), "point": pdf["point"], "path": [p.tobytes() for p in np.ascontiguousarray(path.T)]})

    # a cell that can't be split, of vectors that differ next to nothing, is dealt by hash
    ways = cells.where("leaf").select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias("ways"))
    blocked = members.join(ways, "cell").select(F.concat("cell", F.lit(":"), F.pmod(F.xxhash64("uid"), "ways").cast("string")).alias("block"), "uid", "weight", "point")
    trees = stored(blocked.groupBy("block").applyInPandas(grow, "block string, uid long, weight long, place int, point binary, path binary"), "trees")
    numbered = ways.select("cell", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("i")).select("cell", F.concat("cell", F.lit(":"), F.col("i").cast("string")).alias("block"))
    pairs = open_.join(numbered.select(F.col("cell").alias("x"), F.col("block").alias("bx")), "x").join(numbered.select(F.col("cell").alias("y"), F.col("block").alias("by")), "y")
    pairs = pairs.where("x <> y or bx <= by").select("bx", "by")
    sides = stored(pairs.select(F.col("bx").alias("block"), "bx", "by").union(pairs.where("bx <> by").select(F.col("by").alias("block"), "bx", "by")), "pairs")

    def compare(key_, pdf):
        x, y = key_
        sides_ = []
        for side in sorted({x, y}):
            own = pdf[pdf["block"] == side].sort_values("place")
            tree = Tree(_points(own["point"]), np.frombuffer(b"".join(own["path"]), np.int32).reshape(-1, LEVELS + 1).T, own["weight"].to_numpy())
            sides_.append((tree, own["uid"].to_numpy()[tree.order]))
        (a, ua), (b, ub) = sides_[0], sides_[-1]
        na, nb, (ex, ey) = traverse(a, b, cosine, len(sides_) == 1)
        if len(sides_) == 1:
            uid, n_links = ua, na
        else:
            uid, n_links = np.concatenate([ua, ub]), np.concatenate([na, nb])
            ey = ey + len(ua)
        low = lowest(len(uid), ex, ey, uid)
        hit = n_links > 0
        return pd.DataFrame({"uid": uid[hit], "links": n_links[hit], "low": low[hit]})

    found = stored(trees.join(sides, "block").groupBy("bx", "by").applyInPandas(compare, "uid long, links long, low long"), "found")
    discard(trees)
    # cells that are linked as a whole, of whatever level: by their weights, and through one member each
    under = cells.where("leaf").select("cell", F.explode(F.expr("transform(sequence(1, size(split(cell, '/'))), i -> array_join(slice(split(cell, '/'), 1, i), '/'))")).alias("top"))
    sums = members.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("uid").alias("first")).join(under, "cell")
    sums = stored(sums.groupBy("top").agg(F.sum("all").alias("all"), F.min("first").alias("first")), "sums")
    both = whole.union(whole.where("x <> y").select("y", "x"))
    more = both.join(sums.select(F.col("top").alias("y"), "all", "first"), "y").groupBy("x").agg(F.sum("all").alias("all"), F.min("first").alias("first"), F.max((F.col("x") == F.col("y")).cast("int")).alias("own"))
    more = stored(more.join(under, F.col("x") == F.col("top")).select("cell", "all", "first", "own"), "more")
    at = members.join(more, "cell").select("uid", (F.col("all") - F.when(F.col("own") == 1, F.col("weight")).otherwise(0)).alias("links"), F.col("first").alias("low"))
    star = whole.join(sums.select(F.col("top").alias("x"), F.col("first").alias("a")), "x").join(sums.select(F.col("top").alias("y"), F.col("first").alias("b")), "y").select("a", "b")
    every = stored(found.union(at), "links")
    links = stored(every.groupBy("uid").agg(F.sum("links").alias("links")), "counts")
    groups = stored(components(every.select(F.col("uid").alias("a"), F.col("low").alias("b")).union(star)), "groups")
    named = stored(one.select("uid", "v", "weight", "least").join(links, "uid", "left").join(groups.select(F.col("node").alias("uid"), "component"), "uid", "left")
                   .select("uid", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "uid").alias("component"), "least"), "named")
    least = stored(named.groupBy("component").agg(F.min("least").alias("lowest")), "least")
    labels = stored(named.join(least, "component").select("v", "links", "lowest"), "labels")
    linked = rows.where("fine").select("id", "v").join(labels, "v").select("id", "links", "lowest")
    out = linked.union(rows.where("not fine").select("id", F.lit(0).cast("long"), F.col("id")))
    label = F.coalesce("lowest", "id")
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))
