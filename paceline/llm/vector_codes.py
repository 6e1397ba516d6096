"""Vector codes: parts of vectors by the nearest entry of small codebooks, found under segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from paceline.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts that one label's rows, and one entry's partial sums, are dealt to.
SALTS = 64
#: Components below this are compared as 64-bit integers: squares over a part of 2 ** 10 don't leave them.
WORD = 1 << 26
#: Rounding of the bounds in doubles, as a share of both squared norms: an entry is filtered only beyond it.
SLACK = 1e-11
LARGEST = (1 << 63) - 1

Books = list[list[list[int]]]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers: 64-bit where they are small, Python's integers else."""
    x = x.astype(np.float64)
    if not len(x) or np.abs(x).max() < WORD // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = lambda v: int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE))
    return np.array([[exact(float(v)) for v in row] for row in x], dtype=object)


def _levels(width: int) -> list[np.ndarray]:
    """Where the blocks of each level begin: one block, then twice as many up to half the components."""
    out, n = [], 1
    while n == 1 or n <= width // 2:
        out.append(np.array([width * k // n for k in range(n)]))
        n *= 2
    return out


def _block_means(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and means of the blocks of each row, and the norm of what is left of it without them."""
    lengths = np.diff([*begins, x.shape[1]])
    means = np.add.reduceat(x, begins, axis=1) / lengths
    return lengths, means, np.sqrt(((x - np.repeat(means, lengths, axis=1)) ** 2).sum(1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest of ``entries`` by squared Euclidean distance, ties to the lower index, and that distance.

    By blocks, ||x - c||^2 >= sum of length * (mean of x - mean of c)^2 + (residual norm of x - that of c)^2. An entry
    whose bound is above the exact distance of the most promising entry is out; those that are left meet finer blocks,
    and at last get their exact integer distances.
    """
    if x.dtype == object or entries.dtype == object or x.shape[1] > 1 << 10:
        gap = x.astype(object)[:, None, :] - entries.astype(object)[None]
        far = (gap * gap).sum(2)
        best = np.array([min(range(len(entries)), key=row.__getitem__) for row in far], np.int64)
        return best, far[np.arange(len(x)), best]
    fx, fc = x.astype(np.float64), entries.astype(np.float64)
    slack = SLACK * ((fx * fx).sum(1)[:, None] + (fc * fc).sum(1)[None])
    row, entry, most = None, None, None
    for begins in _levels(x.shape[1]):
        (lengths, mx, rx), (_, mc, rc) = _block_means(fx, begins), _block_means(fc, begins)
        if row is None:
            bound = ((mx[:, None] - mc[None]) ** 2 * lengths).sum(2) + (rx[:, None] - rc[None]) ** 2 - slack
            gap = x - entries[bound.argmin(1)]
            most = (gap * gap).sum(1)
            row, entry = np.nonzero(bound <= most[:, None])
        else:
            bound = ((mx[row] - mc[entry]) ** 2 * lengths).sum(1) + (rx[row] - rc[entry]) ** 2 - slack[row, entry]
            stays = bound <= most[row]
            row, entry = row[stays], entry[stays]
    gap = x[row] - entries[entry]
    far = np.full((len(x), len(entries)), LARGEST)
    far[row, entry] = (gap * gap).sum(1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _book(book: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < WORD for entry in book for v in entry)
    return np.array(book, dtype=np.int64 if small else object)


def kept_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows of ``vectors(vec_id, embedding, label)`` that get a code, as a written table."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"), F.col("label").alias("label"))
    if not isinstance(own.schema["embedding"].dataType, ArrayType):
        raise TypeError("embedding isn't an array")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & finite)
    first = _first(own, 1)
    return written(own.where(F.size("embedding") == (len(first[0]) if first else 0)), "vectors")


def _first(kept: DataFrame, n: int) -> list[list[float]]:
    return [r["embedding"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(n).collect()]


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebooks of ``kept_vectors``: by part, entry and position. The driver holds them and partial sums of theirs only."""
    first = [whole(np.array([v]))[0].tolist() for v in _first(kept, entries)]
    if not first:
        return [[] for _ in range(parts)]
    width = len(first[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
        partial = kept.select("embedding").mapInArrow(_sums(books, width), "part int, entry int, salt int, n long, sums array<string>")
        for r in partial.groupBy("part", "entry", "salt").applyInArrow(_added, partial.schema).collect():  # at most parts * entries * SALTS rows
            n, old = sums.get((r["part"], r["entry"]), (0, [0] * width))
            sums[r["part"], r["entry"]] = n + r["n"], [a + int(b) for a, b in zip(old, r["sums"])]
        books = [[[s // sums[p, e][0] for s in sums[p, e][1]] if (p, e) in sums else old for e, old in enumerate(book)] for p, book in enumerate(books)]
    return books


_SUMS = ["part", "entry", "salt", "n", "sums"]


def _sums(books: Books, width: int) -> Callable:
    """Count and sums of the components that each entry gets in a task, as text: they may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = [_book(b) for b in books], {}
        for b in batches:
            x = _matrix(b.column("embedding"), width * len(books))
            for p, table in enumerate(tables):
                own = x[:, p * width : (p + 1) * width]
                best, _ = nearest(own, table) if len(own) else (np.zeros(0, np.int64), None)
                for e in np.unique(best):
                    rows = own[best == e]
                    n, old = total.get((p, e), (0, [0] * width))
                    total[p, e] = n + len(rows), [a + int(s) for a, s in zip(old, rows.sum(0))]
        salt = TaskContext.get().partitionId() % SALTS
        keys = sorted(total)
        cols = [[p for p, _ in keys], [e for _, e in keys], [salt] * len(keys), [total[k][0] for k in keys], [list(map(str, total[k][1])) for k in keys]]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _SUMS)

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    total = [str(sum(map(int, column))) for column in zip(*(r["sums"] for r in rows))]
    one = {**rows[0], "n": sum(r["n"] for r in rows), "sums": total}
    return pa.Table.from_pylist([one], schema=table.schema)


def coded(kept: DataFrame, books: Books) -> DataFrame:
    """``kept_vectors`` to vec_id, label, code (array of int), error: the nearest entry of each part, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_book(b) for b in books]
        width = len(books[0][0]) if books[0] else 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("embedding"), width * len(books))
            found = [nearest(x[:, p * width : (p + 1) * width], table) for p, table in enumerate(tables)]
            codes = pa.array(list(np.stack([best for best, _ in found], 1).astype(np.int32)), pa.list_(pa.int32()))
            errors = [min(sum(map(int, far)), LARGEST) for far in zip(*(far for _, far in found))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), codes, pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, code array<int>, error long")


def books_text(books: Books) -> str:
    """All entries' components as decimal integers, by part, entry and position, joined by commas."""
    return ",".join(str(v) for book in books for entry in book for v in entry)


def hex_code(code: Column) -> Column:
    return F.lower(F.array_join(F.transform(code, lambda i: F.lpad(F.hex(i), 2, "0")), ""))


def vector_codes(vectors: DataFrame) -> DataFrame:
    """One row per kept row of ``vectors(vec_id, embedding, label)``: vec_id, code (hex), error, label_error, codebooks_sha256.

    Codebooks start from the parts of the ENTRIES smallest vec_ids, of all where there are fewer, and are refitted for
    ROUNDS rounds, each a pass over the table that returns counts and exact sums by entry and task. Rows go whose vector
    is null, holds null or non-finite components, or has another length than the row of the smallest vec_id among those
    whose length is a multiple of PARTS. Null vec_ids are kept and come last, rows that repeat one come in the order of
    their vectors. Equal labels are summed by (label, salt) first, nulls are one label, and a label's sum meets its rows
    by salt. Components may have any finite size; sums of errors beyond 64 bits count as 2^63 - 1. Other columns aren't
    read; no kept row gives no rows.
    """
    kept = kept_vectors(vectors)
    books = fit_codebooks(kept)
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    rows = written(coded(kept, books), "vector-codes").withColumn("salt", salt)
    total = F.sum(F.col("error").cast("decimal(38,0)")).alias("error")
    sums = rows.groupBy("label", "salt").agg(total).groupBy("label").agg(total)
    sums = sums.select(F.col("label").alias("of"), F.least("error", F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("at"))
    out = rows.join(sums.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select("vec_id", hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
