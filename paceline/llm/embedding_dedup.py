"""Embedding near-dedup: a forest of random-projection trees with spill overlap, comparison within leaves, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, components, written

COSINE = 0.95
TREES = 6
#: Vectors that the trees are fitted on, at most; all vectors are indexed.
SAMPLE = 32_768
#: Sample vectors in a node that isn't split further; below, splits go on by the medians of its sample.
NODE = 64
#: Aimed-at vectors of a leaf; a larger one is compared in blocks of this size.
LEAF, BLOCK = 256, 1024
#: Spill to either side of a split, in standard deviations of the projected distance of two vectors that just link.
SPILL = 0.75
_ROW = "tree int, leaf long, vec_id long, weight long, vec binary, codes array<bigint>"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vecs: list[bytes | None] = []
        for x in b.column("embedding").to_pylist():
            v = None if x is None or any(y is None for y in x) else np.array(x, np.float64) + 0.0
            usable = v is not None and v.size and np.isfinite(v).all() and v.any()
            # Scaled by a power of two, which is exact and changes no cosine: squares neither overflow nor vanish.
            vecs.append((np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0).tobytes() if usable else None)
        keys = [None if v is None else xxhash.xxh3_128_digest(v) for v in vecs]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "key", "vec"])


class Tree:
    """Random splits at medians of a sample, down to NODE vectors; ``extra`` more by directions that all leaves share."""

    def __init__(self, sample: np.ndarray, extra: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        self.spill, self.extra = spill, extra
        self.splits: dict[int, tuple[np.ndarray, float]] = {}
        self.more = rng.standard_normal((extra, sample.shape[1]))
        self.more /= np.linalg.norm(self.more, axis=1, keepdims=True)
        self.medians: dict[int, np.ndarray] = {}
        todo = [(1, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) > NODE:
                r = rng.standard_normal(sample.shape[1])
                r /= np.linalg.norm(r)
                p = sample[rows] @ r
                cut = float(np.median(p))
                left, right = rows[p < cut], rows[p >= cut]
                if len(left) and len(right):
                    self.splits[node] = (r, cut)
                    todo += [(2 * node, left), (2 * node + 1, right)]
                    continue
            self.medians[node] = np.median(sample[rows] @ self.more.T, axis=0) if len(rows) else np.zeros(extra)

    def leaves(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Leaves and the rows of ``x`` in each; a row near a split goes to both of its sides."""
        out, todo = [], [(1, 0, np.arange(len(x)))]
        while todo:
            node, depth, rows = todo.pop()
            if not len(rows):
                continue
            if node in self.splits:
                r, cut = self.splits[node]
                p = x[rows] @ r - cut
                todo += [(2 * node, 0, rows[p < self.spill]), (2 * node + 1, 0, rows[p >= -self.spill])]
            else:
                halves = [(0, rows)]
                for k in range(self.extra):
                    new = []
                    for code, own in halves:
                        p = x[own] @ self.more[k] - self.medians[node][k]
                        new += [(2 * code, own[p < self.spill]), (2 * code + 1, own[p >= -self.spill])]
                    halves = [h for h in new if len(h[1])]
                out += [((node << self.extra) + code, own) for code, own in halves]
        return out


def _assign(forest) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for b in batches:
            vecs = b.column("vec").to_pylist()
            if not vecs:
                continue
            x = np.stack([np.frombuffer(v) for v in vecs])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            who, tree, leaf = [], [], []
            for t, one in enumerate(trees):
                for code, rows in one.leaves(x):
                    who.append(rows)
                    tree.append(np.full(len(rows), t, np.int32))
                    leaf.append(np.full(len(rows), code, np.int64))
            who, tree, leaf = np.concatenate(who), np.concatenate(tree), np.concatenate(leaf)
            codes: list[list[int]] = [[] for _ in vecs]
            for w, c in zip(who.tolist(), (leaf * TREES + tree).tolist(), strict=True):
                codes[w].append(c)
            for lo in range(0, len(who), 4000):
                part = slice(lo, lo + 4000)
                mine = who[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree[part]), pa.array(leaf[part]), b.column("vec_id").take(pa.array(mine)), b.column("weight").take(pa.array(mine)), b.column("vec").take(pa.array(mine)), pa.array([codes[w] for w in mine], pa.list_(pa.int64()))],
                    [x.split()[0] for x in _ROW.split(", ")],
                )

    return run


def _compare(cosine: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one leaf or pair of blocks: links of each vector that no earlier leaf has, and links that join its vectors."""
        pdf = pdf.reset_index(drop=True)
        x = np.stack([np.frombuffer(v) for v in pdf["vec"]])
        norms = np.linalg.norm(x, axis=1)
        unit = x / norms[:, None]
        close = np.triu(unit @ unit.T >= cosine - 1e-9, 1)
        block = pdf["block"].to_numpy()
        if block.min() != block.max():
            close &= block[:, None] != block[None, :]
        i, j = np.nonzero(close)
        exact = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= cosine
        i, j = i[exact], j[exact]
        here = int(pdf["leaf"].iloc[0]) * TREES + int(pdf["tree"].iloc[0])
        order = lambda c: (c % TREES, c)
        codes = pdf["codes"]
        earlier = {a: {c for c in codes[a] if order(c) < order(here)} for a in np.unique(np.concatenate([i, j])).tolist()}
        first = np.fromiter((earlier[a].isdisjoint(earlier[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        i, j = i[first], j[first]
        weight, ids = pdf["weight"].to_numpy(), pdf["vec_id"].to_numpy()
        counts = np.bincount(i, weight[j], len(pdf)) + np.bincount(j, weight[i], len(pdf))
        parent = list(range(len(pdf)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        edges = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((ids[a], ids[b]))
        some = np.nonzero(counts)[0]
        rows = [(ids[k], None, int(counts[k])) for k in some] + [(a, b, 0) for a, b in edges]
        return pd.DataFrame({"a": pd.array([r[0] for r in rows], "Int64"), "b": pd.array([r[1] for r in rows], "Int64"), "n": pd.array([r[2] for r in rows], "Int64")})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``cosine`` or more, in double precision. Null and zero vectors and those with null or
    non-finite components link with nothing, as do vectors of different lengths with each other.

    Equal vectors become one with a weight, so a group of copies is never expanded. Each of TREES trees splits the space by random
    directions at medians of a bounded sample and, beyond the sample's depth, at medians within its leaves, as deep as
    the number of vectors asks for; a vector near a split goes to both sides. Leaves are compared whole: a pair counts in the first leaf
    that both are in, so links are summed by vector without emitting pairs, and a leaf returns only as many links as
    join its vectors. A leaf over BLOCK vectors is compared block by block.

    Null vec_ids link with nothing and are kept with a null component; rows that repeat a vec_id with equal vectors
    count as two vectors of one name. An empty table gives no rows; other columns aren't read.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = own.mapInArrow(_keys, "vec_id long, key binary, vec binary")
    named = keyed.where("key is not null and vec_id is not null")
    classes = checkpointed(named.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first(F.octet_length("vec")).alias("bytes")))
    reps = named.select("key", F.col("vec_id").alias("rep"), "vec").join(classes, ["key", "rep"])
    reps = written(reps.dropDuplicates(["key"]).select(F.col("rep").alias("vec_id"), "weight", "bytes", "vec"), "vectors")
    found = [_links(reps.where(F.col("bytes") == r["bytes"]), r["bytes"] // 8, r["n"], cosine, trees) for r in reps.groupBy("bytes").agg(F.count("*").alias("n")).collect()]
    if found:
        made = found[0]
        for f in found[1:]:
            made = made.unionByName(f)
        made = checkpointed(made)
        counts = made.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        comps = components(made.where("b is not null").select("a", "b"))
    else:
        counts = classes.select("rep", F.lit(0).cast("long").alias("n")).limit(0)
        comps = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    per = classes.join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    per = per.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = keyed.select("vec_id", "key").join(per, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    n = F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, dim: int, n: int, cosine: float, trees: int) -> DataFrame:
    sample = reps.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vec").toPandas()["vec"]
    x = np.stack([np.frombuffer(v) for v in sample])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    extra = max(0, int(np.ceil(np.log2(max(n, 1) / max(len(x), 1) * NODE / LEAF))))
    spill = SPILL * float(np.sqrt((2 - 2 * cosine) / dim))
    forest = reps.sparkSession.sparkContext.broadcast([Tree(x, extra, spill, 1000 + t) for t in range(trees)])
    rows = reps.select("vec_id", "weight", "vec").mapInArrow(_assign(forest), _ROW)
    big = rows.groupBy("tree", "leaf").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    placed = rows.join(big, ["tree", "leaf"], "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("tree", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "weight", "vec", "codes")
    return placed.groupBy("tree", "leaf", "i", "j").applyInPandas(_compare(cosine), "a long, b long, n long")
