"""Dense symmetric systems of any size: blocks in files that all executors share, factored by many tasks.

A matrix of ``n`` lines is the product of a lower triangle of blocks, signs, and the triangle turned over. No task holds more
than a few blocks, or one line of them by a few columns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from .. import scratch
from ..grid import in_task

#: Lines of a block: 8 MB of numbers.
LINES = 1024


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, block: np.ndarray) -> None:
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    own = f"{root}/{name}.{uuid.uuid4().hex}"  # a task that runs twice leaves one whole file
    with files.open_output_stream(own) as f:
        f.write(np.ascontiguousarray(block, np.float64))
    files.move(own, f"{root}/{name}")


def get(folder: str, name: str, lines: int) -> np.ndarray:
    files, root = _files(folder)
    with files.open_input_stream(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), np.float64).reshape(lines, -1)


def inverse(k: np.ndarray) -> np.ndarray:
    try:
        got = np.linalg.inv(k)
        if not np.isfinite(got).all():
            raise np.linalg.LinAlgError
        return got
    except np.linalg.LinAlgError:
        return np.linalg.pinv(k)


def rooted(k: np.ndarray) -> np.ndarray:
    """What turns ``k`` into signs, and the signs as a last column: the inverse of its Cholesky root, or that of the roots of its
    eigenvalues where it isn't definite. Values that are zero but for rounding are left out."""
    try:
        return np.column_stack([np.linalg.inv(np.linalg.cholesky(k)), np.ones(len(k))])
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh((k + k.T) / 2)
        size = np.abs(value)
        root = np.where(size > np.finfo(float).eps * size.max(), 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
        return np.column_stack([root[:, None] * vector.T, np.where(value < 0, -1.0, 1.0)])


@dataclass
class Factor:
    """Files ``M_i_j`` below the diagonal and ``R_k``, what turns a block of the diagonal into signs."""

    folder: str
    n: int
    lines: int

    @property
    def parts(self) -> list[slice]:
        return [slice(s, min(s + self.lines, self.n)) for s in range(0, self.n, self.lines)]

    def below(self, i: int, j: int) -> np.ndarray:
        return get(self.folder, f"M_{i}_{j}", min(self.lines, self.n - i * self.lines))

    def root(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        got = get(self.folder, f"R_{k}", min(self.lines, self.n - k * self.lines))
        return got[:, :-1], got[:, -1:]

    def forward(self, b: np.ndarray) -> None:
        """``b`` becomes what the lower triangle takes to ``b``."""
        for i, p in enumerate(self.parts):
            for j, q in enumerate(self.parts[:i]):
                b[p] -= self.below(i, j) @ b[q]
            b[p] = self.root(i)[0] @ b[p]

    def squares(self, b: np.ndarray) -> np.ndarray:
        """Of each column its product with the inverse and itself; ``b`` is used up."""
        self.forward(b)
        return sum((self.root(i)[1] * b[p] ** 2).sum(0) for i, p in enumerate(self.parts))

    def solve(self, b: np.ndarray) -> np.ndarray:
        b = np.array(b, np.float64)
        self.forward(b)
        for i, p in enumerate(self.parts):
            b[p] *= self.root(i)[1]
        for i, p in reversed(list(enumerate(self.parts))):
            b[p] = self.root(i)[0].T @ b[p]
            for j, q in enumerate(self.parts[:i]):
                b[q] -= self.below(i, j).T @ b[p]
        return b


def factored(spark: SparkSession, n: int, entries, lines: int | None = None) -> Factor:
    """The factor of the symmetric matrix whose blocks ``entries(rows, columns)`` gives, both slices.

    Blocks are factored column by column, a task a block; a block of the matrix is worked out where it is needed. Roots are taken
    within the diagonal's blocks only, so the matrix should be definite or nearly so.
    """
    own = Factor(scratch.path(spark, "blocks"), n, lines or LINES)
    parts = own.parts

    def less(i, k):
        s = entries(parts[i], parts[k])
        for j in range(k):
            s -= own.below(i, j) @ (own.root(j)[1] * own.below(k, j).T)
        return s

    def corner(k):
        put(own.folder, f"R_{k}", rooted(less(k, k)))

    spark.sparkContext.parallelize([0], 1).foreach(corner)
    for k in range(len(parts) - 1):
        def column(i, k=k):
            root, sign = own.root(k)
            put(own.folder, f"M_{i}_{k}", less(i, k) @ (sign * root).T)
            if i == k + 1:
                corner(i)

        spark.sparkContext.parallelize(range(k + 1, len(parts)), len(parts) - k - 1).foreach(column)
    return own


@dataclass
class Dual:
    """What solves a system with side conditions: ``weights`` of the unknowns and ``trend`` of the conditions' columns;
    ``bent``, the inverse times those columns, and ``spread``, the inverse of the columns' product with it."""

    factor: Factor
    weights: np.ndarray
    trend: np.ndarray
    bent: np.ndarray
    spread: np.ndarray


def dual(spark: SparkSession, entries, columns: np.ndarray, values: np.ndarray) -> Dual:
    """Weights w and trend t of matrix w + columns t = values, where the columns' products with w vanish."""
    factor = factored(spark, len(values), entries)

    def run():
        got = factor.solve(np.column_stack([columns, values]))
        bent, flat = got[:, :-1], got[:, -1]
        spread = inverse(columns.T @ bent)
        trend = spread @ (bent.T @ values)
        return Dual(factor, flat - bent @ trend, trend, bent, spread)

    return in_task(spark, run)
