"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A document is the mean of the vectors of its character n-grams (hashed, within
words), so that unseen spellings share most vectors with seen ones. The vectors and the
softmax over them are trained together in numpy on a bounded sample; as both are
linear, scoring needs one number a bucket, and those are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks
from .common import stored, text_column
from .ngrams import grams, joined, scores

SIZES = range(3, 7)
BITS = 20
BLOCK_CHARS = 500_000


class Model:
    """One weight a bucket (``table``) and a bias; a text's logit is the mean weight plus the bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def probability(self, texts: pa.Array) -> np.ndarray:
        sums, counts = scores(texts, self.table, SIZES, BITS)
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(counts, 1) + self.bias, -50, 50)))


def _grams(text: str) -> np.ndarray:
    buf, _ = joined(pa.array([text], pa.string()))
    return np.concatenate([np.zeros(0, np.int32), *[b[fine] for _, b, fine in grams(buf, SIZES, BITS)]])


def _bag(texts: list[str], keep: np.ndarray):
    """(document, bucket, share): of each text the shares of the kept n-grams, sorted by document."""
    doc, bucket, share = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0)]
    for i, text in enumerate(texts):
        got = _grams(text)
        u, n = np.unique(got[keep[got]], return_counts=True)
        doc.append(np.full(len(u), i, np.int32))
        bucket.append(u)
        share.append(n / max(len(got), 1))
    return np.concatenate(doc), np.concatenate(bucket), np.concatenate(share)


def _telling(texts: list[str], y: np.ndarray, least: float) -> np.ndarray:
    """Buckets whose share of texts differs between the classes by ``least`` standard errors."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for text, label in zip(texts, y):
        seen[int(label), np.unique(_grams(text))] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    both = (seen[0] + seen[1]) / len(y)
    error = np.sqrt(np.maximum(both * (1 - both) * (1 / n0 + 1 / n1), 1e-12))
    return np.abs(seen[1] / n1 - seen[0] / n0) >= least * error


def train(texts: list[str], labels: list[int], prior: float, width: int = 4, least: float = 6.0, rounds: int = 200, rate: float = 0.5, seed: int = 7) -> Model:
    """Joint gradient descent on the embeddings and the softmax.

    ``prior`` is the share of label 1 among the labelled rows that the sample comes from; the
    classes are weighted to it. Only buckets that tell the classes apart by ``least``
    standard errors get vectors; the others stay at zero.
    """
    y = np.array(labels, np.float64)
    p = np.clip(prior, 1e-6, 1 - 1e-6)
    flat = Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return flat
    doc, bucket, share = _bag(texts, _telling(texts, y, least))
    if not len(doc):
        return flat
    used, place = np.unique(bucket, return_inverse=True)
    order = np.argsort(place, kind="stable")
    doc_by, share_by = doc[order], share[order]
    first = np.searchsorted(place[order], np.arange(len(used)))
    # each bucket's scale: rare ones count as much as frequent ones
    spread = np.sqrt(np.maximum(np.add.reduceat(share_by.astype(np.float64) ** 2, first) / len(y), 1e-12))
    share, share_by = share / spread[place], share_by / spread[place[order]]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (len(used), width))
    heads = rng.normal(0, 1, (width, 2))
    bias = np.log(np.array([1 - p, p]))
    weight = np.where(y == 1, p / y.mean(), (1 - p) / (1 - y.mean())) / len(y)
    target = np.stack([1 - y, y], 1)
    speed_v, speed_h, speed_b = np.zeros_like(vectors), np.zeros_like(heads), np.zeros(2)
    norm = np.sqrt(np.maximum(np.bincount(doc, share**2, len(y)), 1e-12)).mean()
    for _ in range(rounds):
        mean = np.stack([np.bincount(doc, share * vectors[place, k], len(y)) for k in range(width)], 1) / norm
        logit = mean @ heads + bias
        logit -= logit.max(1, keepdims=True)
        guess = np.exp(logit)
        guess /= guess.sum(1, keepdims=True)
        error = (guess - target) * weight[:, None]
        back = error @ heads.T / norm
        step_v = np.stack([np.add.reduceat(share_by * back[doc_by, k], first) for k in range(width)], 1)
        step_h = mean.T @ error
        speed_v = 0.9 * speed_v - rate * step_v
        speed_h = 0.9 * speed_h - rate * step_h
        speed_b = 0.9 * speed_b - rate * error.sum(0)
        vectors += speed_v
        heads += speed_h
        bias = bias + speed_b
    table = np.zeros(1 << BITS, np.float32)
    table[used] = (vectors @ (heads[:, 1] - heads[:, 0])) / spread / norm
    return Model(table, float(bias[1] - bias[0]))


def held_out(key):
    """Whether a row is left out of training: crc32 of the key as text is 2 modulo 4 (null: no)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 1500, chars: int = 12_000_000) -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out.

    The bound: per class the first ``rows`` keys by hash, and of those, in that order,
    as many as hold ``chars`` bytes of text together (half for each class). A key's
    label is the largest that it has; null labels and keys are left out.
    """
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull()).select(labels[key].alias("id"), labels[label].cast("int").alias("y"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        picked = some if picked is None else picked.union(some)
    sample = stored(docs.select(docs[key].alias("id"), text_column(docs, text).alias("text")).join(F.broadcast(picked), "id"), "sample")
    sizes = sorted(sample.select("y", F.xxhash64("id").alias("h"), "id", F.octet_length("text").alias("n")).distinct().collect(), key=lambda r: (r["h"], r["id"], r["n"]))
    spent, ids = {0: 0, 1: 0}, set()
    for r in sizes:
        if spent[r["y"]] + r["n"] <= chars // 2:
            spent[r["y"]] += r["n"]
            ids.add(r["id"])
    got = sample.where(F.col("id").isin(sorted(ids))).dropDuplicates(["id", "text"]).orderBy("id", "text").collect() if ids else []
    return train([r["text"] for r in got], [r["y"] for r in got], share or 0.0)


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for every row.

    The score reads the whole text and nothing else. Null and empty texts, and texts
    without any letter, get the score of an average without evidence (the bias).
    Repeated rows and null keys get rows of their own; a very long text is a block of its own; other
    columns aren't read, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # 4 MB, whatever the input

    def run(batches):
        own = Model(*shared.value)
        for part, texts in blocks(batches, 1, BLOCK_CHARS):
            p = own.probability(pa.array(texts, pa.large_string()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("id"), text_column(docs, text).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
