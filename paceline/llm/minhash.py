"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, components, written

WORDS = 5
K = 64
#: Links: LINK * intersection of 100 >= 75 * union.
PERCENT = 75
#: Standard deviations of slack wherever a sketch decides what isn't looked at further.
SLACK = 4.0
#: Members of a list's hub that are compared at once; larger groups are cut into blocks and compared block by block.
BLOCK = 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; of fewer words, one of them all."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = h[:n] * _MIX[0]
    for j in range(1, words):
        out = (out ^ (out >> np.uint64(31))) * _MIX[j % 5] + h[j : n + j]
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(x) for x in b.column("text").to_pylist()]
        low = [s[:K].view(np.int64) for s in sets]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
        flat = np.concatenate(low) if low else np.empty(0, np.int64)
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, keys, pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["doc_id", "n_shingles", "set_key", "sketch"])


def least_overlap(m: float | Column) -> Column | float:
    """Retained values that two linked documents share, but for SLACK deviations, of the ``m`` that each retains."""
    share = PERCENT / 100
    if isinstance(m, Column):
        return F.greatest(F.floor(share * m - SLACK * F.sqrt(share * (1 - share) * m)), F.lit(1))
    return max(math.floor(share * m - SLACK * math.sqrt(share * (1 - share) * m)), 1)


def _linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 100 * inter >= PERCENT * (na + nb - inter)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, np.ndarray] = ("", shingle_set(""))
    for b in batches:
        out = []
        for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
            if y != last[0]:
                last = (y, shingle_set(y))
            a, c = shingle_set(x), last[1]
            inter = len(np.intersect1d(a, c, assume_unique=True))
            out.append(bool(_linked(inter, len(a), len(c))))
        mask = pa.array(out, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(mask)


def _overlaps(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over slices of the shared values."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    index = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    who, column = who[shared], index[inverse[shared]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int((counts > 1).sum()), width):
        a, z = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[who[a:z], column[a:z] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _cross(pdf: pd.DataFrame) -> np.ndarray:
    """Pairs this task is to compare: of different components, and, where it has two blocks, of different blocks."""
    comp, block = pdf["comp"].to_numpy(), pdf["block"].to_numpy()
    mask = comp[:, None] != comp[None, :]
    if len(set(block.tolist())) > 1:
        mask &= block[:, None] != block[None, :]
    return np.triu(mask, 1)


def _active(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a task's documents, those that by their sketches may link with one of another component."""
    pdf = pdf.drop_duplicates("doc").reset_index(drop=True)
    n = pdf["n"].to_numpy()
    sketches = [np.asarray(x, np.int64) for x in pdf["sketch"]]
    m = np.array([len(x) for x in sketches])
    inter = _overlaps(sketches)
    small = np.minimum(n[:, None], n[None, :])
    large = np.maximum(n[:, None], n[None, :])
    need = np.array([least_overlap(x) for x in range(K + 1)])[np.minimum(m[:, None], m[None, :])]
    may = (100 * small >= PERCENT * large) & (inter >= need)
    may &= (large > K) | _linked(inter, n[:, None], n[None, :])
    may &= _cross(pdf)
    return pdf.loc[may.any(0) | may.any(1), ["hub", "i", "j", "block", "doc", "comp"]]


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of a task's documents, by their full sets; as many as join them, not all pairs."""
    pdf = pdf.drop_duplicates("doc").reset_index(drop=True)
    sets = [shingle_set(t) for t in pdf["text"]]
    n = np.array([len(s) for s in sets])
    hits = np.argwhere(_linked(_overlaps(sets), n[:, None], n[None, :]) & _cross(pdf))
    parent = {c: c for c in pdf["comp"]}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    doc, comp, out = pdf["doc"].to_numpy(), pdf["comp"].to_numpy(), []
    for i, j in hits:
        a, b = root(comp[i]), root(comp[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((doc[i], doc[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of five words (fewer words: the whole sequence; none: empty, linked with
    nothing). Two documents link when 100 * |intersection| >= 75 * |union|; a component takes its smallest doc_id.

    1. A sketch is the K smallest hashes of the set. Documents of equal sets are one from here on, so a group of any
       number of copies is one sketch.
    2. Inverted lists hold the retained values. A document enters only the lists of its rarest values, as many as make
       it sure (but for SLACK deviations) to meet any document it links with; values that only it has need no list.
       Frequent lines and passages are therefore not met at all.
    3. Each list pairs its members with its smallest one, the hub, not with each other. Pairs whose sizes and whose
       estimate from the sketch of their union allow a link are verified on full sets; links give components.
    4. Where members of a hub remain in several components, the members themselves are compared: in blocks of bounded
       size, first by sketch, then, those left, by full sets. No list is capped and no pair of a list is skipped
       unless it is in one component already or its sketches exclude a link.

    A null doc_id links with nothing and is kept with a null component. Rows that repeat a doc_id are one document.
    Columns other than doc_id and text aren't read. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = written(own.mapInArrow(_sketches, "doc_id long, n_shingles long, set_key binary, sketch array<bigint>"), "sketches")
    named = prints.where("doc_id is not null and n_shingles > 0")
    classes = checkpointed(named.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = named.select(F.col("doc_id").alias("rep"), "set_key", F.col("n_shingles").alias("n"), "sketch").join(classes, ["set_key", "rep"], "left_semi")
    reps = reps.select(F.col("rep").alias("doc"), "n", "sketch")

    entries = reps.select("doc", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    found = entries.join(common, "value").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("shared"))  # K at most
    m = F.size("sketch")
    found = found.join(reps.select("doc", m.alias("m")), "doc")
    first = F.col("m") - least_overlap(F.col("m")) + 1 - (F.col("m") - F.size("shared"))
    lists = found.where(first > 0).select("doc", F.explode(F.slice("shared", F.lit(1), first.cast("int"))).alias("s")).select("doc", F.col("s.value").alias("value"))
    lists = checkpointed(lists)
    hubs = lists.groupBy("value").agg(F.min("doc").alias("hub"), F.count("*").alias("size")).where("size > 1").select("value", "hub")
    star = checkpointed(lists.join(hubs, "value").where("doc <> hub").select("hub", "doc").distinct())

    texts = own.join(star.select(F.explode(F.array("hub", "doc")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = written(texts.dropDuplicates(["doc_id"]), "candidates")
    side = lambda s: reps.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    pairs = star.select(F.col("doc").alias("a"), F.col("hub").alias("b")).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, K)
    estimate = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)) / F.size(union)
    whole = F.greatest("n_a", "n_b") <= K
    share = PERCENT / 100
    pairs = pairs.where(F.when(whole & (F.size(F.array_union("sketch_a", "sketch_b")) <= K), estimate >= share - 1e-9).otherwise(estimate >= share - SLACK * math.sqrt(share * (1 - share) / K)))
    text = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))
    links = checkpointed(pairs.select("a", "b").join(text("a"), "a").join(text("b"), "b").mapInArrow(_verify, "a long, b long"))
    comps = checkpointed(components(links))

    links = links.unionByName(checkpointed(_between(star, comps, reps, texts)))
    comps = components(links)
    joined = classes.join(comps, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("c"))
    out = prints.select("doc_id", "n_shingles", "set_key").join(joined, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _between(star: DataFrame, comps: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components among the members of a hub, which the pairs with the hub haven't shown."""
    members = star.join(comps, F.col("doc") == F.col("node"), "left").select("hub", "doc", F.coalesce("component", "doc").alias("comp"))
    open_ = members.groupBy("hub").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(open_.select("hub", blocks.alias("blocks")), "hub").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "comp")
    active = placed.join(reps, "doc").groupBy("hub", "i", "j").applyInPandas(_active, "hub long, i int, j int, block int, doc long, comp long")
    active = checkpointed(active)
    wide = active.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return wide.groupBy("hub", "i", "j").applyInPandas(_resolve, "a long, b long")
