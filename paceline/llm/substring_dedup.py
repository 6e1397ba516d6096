"""Substring dedup: remove words covered by windows of 20 words that occur earlier in the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 20
#: Words of an anchor, the part of a window by which equal windows meet.
ANCHOR = 8
#: Bytes of a window's hash that go along with its anchor's 64 bits.
BYTES = 6
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def anchored(words: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's windows: where runs with one anchor begin, the runs' anchor hashes, all windows' hashes.

    The anchor of a window is its ANCHOR consecutive words with the least hash, the first of equal ones: equal windows
    have equal anchors, and neighbouring windows mostly share theirs.
    """
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - ANCHOR + 1
    g = h[:m] * _MIX[0]
    for j in range(1, ANCHOR):
        g = _scramble(g) + h[j : m + j] * _MIX[j % 4]
    g = _scramble(g)
    w = np.zeros(n, np.uint64)
    for j in [*range(0, length - ANCHOR + 1, ANCHOR), length - ANCHOR]:
        w = _scramble(w * _MIX[2] + g[j : n + j])
    least = np.lib.stride_tricks.sliding_window_view(g, length - ANCHOR + 1).argmin(axis=1) + np.arange(n)
    runs = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return runs, g[least[runs]], w


def _pieces(mask: np.ndarray, breaks: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal stretches of ``mask``, also cut where ``breaks`` is set: beginnings and ends."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    begins, ends = edge[:-1] == 1, edge[1:] == -1
    cut = mask & breaks & ~begins
    begins = begins | cut
    ends[np.flatnonzero(cut) - 1] = True
    return np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist()


def _runs(length: int) -> Callable:
    """Rows of windows that share an anchor, for comparison with other tasks' rows; and rows with ``n``, windows that
    the same few hundred documents have earlier. However often a window occurs in them, it travels once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                ids, begins, keys, hashes, at = [], [], [], [], []
                for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
                    runs, anchors, w = anchored((text or "").encode().split(), length)
                    if len(w):
                        ids.append(doc)
                        at.append(len(w))
                        begins.append(runs)
                        keys.append(np.repeat(anchors, np.diff(np.r_[runs, len(w)])))
                        hashes.append(w)
                out: dict[str, list] = {k: [] for k in ("anchor", "doc_id", "start", "n", "hashes")}
                if ids:
                    w, key = np.concatenate(hashes), np.concatenate(keys).view(np.int64)
                    base = np.r_[0, np.cumsum(at)[:-1]]
                    owner = np.repeat(np.arange(len(ids)), at)
                    _, first, back = np.unique(w, return_index=True, return_inverse=True)
                    own = first[back] == np.arange(len(w))
                    new_run, new_doc = np.zeros(len(w), bool), np.zeros(len(w), bool)
                    new_run[np.concatenate([r + o for r, o in zip(begins, base, strict=True)])] = True
                    new_doc[base] = True
                    raw = w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
                    for a, z in zip(*_pieces(own, new_run), strict=True):
                        o = owner[a]
                        for c, v in zip(out, (int(key[a]), ids[o], a - int(base[o]), None, raw[BYTES * a : BYTES * z]), strict=True):
                            out[c].append(v)
                    # Rows of one doc_id at one place aren't repeats of each other.
                    same = np.zeros(len(w), bool)
                    if len(set(ids)) < len(ids):
                        f = first[back]
                        names = {d: k for k, d in enumerate(dict.fromkeys(ids))}
                        name = np.array([names[d] for d in ids])
                        same = ~own & (name[owner] == name[owner[f]]) & (np.arange(len(w)) - base[owner] == f - base[owner[f]])
                    for a, z in zip(*_pieces(~own & ~same, new_doc), strict=True):
                        o = owner[a]
                        start = a - int(base[o])
                        spread = xxhash.xxh3_64_intdigest(f"{ids[o]} {start}") - (1 << 63)
                        for c, v in zip(out, (spread, ids[o], start, z - a, None), strict=True):
                            out[c].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, doc_id and start to (doc_id, start, n): n windows from start on that an earlier row has."""
    last, first = None, {}
    for b in batches:
        anchors = b.column("anchor").to_numpy()
        if not len(anchors):
            continue
        same = np.r_[anchors[0] == last, anchors[1:] == anchors[:-1]]
        more = np.r_[same[1:], True]  # the last row's group may go on in the next batch
        rows = np.flatnonzero(same | more | b.column("n").is_valid().to_numpy(zero_copy_only=False))
        part = b.take(pa.array(rows))
        out: list[tuple] = []
        for i, doc, start, n, hashes in zip(rows.tolist(), *(part.column(c).to_pylist() for c in ("doc_id", "start", "n", "hashes")), strict=True):
            if not same[i]:
                first = {}
            if n is not None:
                out.append((doc, start, n))
                continue
            begin = None
            for k in range(len(hashes) // BYTES):
                here = (doc, start + k)
                if first.setdefault(hashes[BYTES * k : BYTES * (k + 1)], here) != here:
                    begin = k if begin is None else begin
                elif begin is not None:
                    out.append((doc, start + begin, k - begin))
                    begin = None
            if begin is not None:
                out.append((doc, start + begin, len(hashes) // BYTES - begin))
        last = anchors[-1]
        kinds = (pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "start", "n"])


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                words = (text or "").encode().split()
                if marks:
                    edge = np.zeros(len(words) + length + 1, np.int64)
                    for m in marks:
                        if m["start"] < len(words):
                            edge[m["start"]] += 1
                            edge[min(m["start"] + m["n"] - 1 + length, len(words))] -= 1
                    gone = np.cumsum(edge)[: len(words)] > 0
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_text (kept words, one space between).

    A window is ``length`` consecutive words of one document; every word that is covered by a window whose sequence
    of words also starts earlier (smaller doc_id, or same document and earlier start) goes; windows are judged on the
    input. Every window of every text is compared. A window travels with its anchor, a short run of words that any
    equal window has too, so that neighbouring windows share a row. Of a window that some hundred documents read
    together hold several times, only the first goes to the shuffle, so a frequent passage, or a word pair repeated
    over a whole text, is a row a batch. Rows are sorted by anchor, not gathered: a task streams over them and holds the first places of one
    anchor's windows. Windows are equal when 64 bits of the
    anchor's and 48 of the window's hash are.

    Null texts have no words. Null doc_ids count as smallest and together as one document, as do rows that repeat a doc_id: of
    these, words at equal places aren't repeats of each other, and what goes from one goes from all. Texts under ``length``
    words stay whole. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    runs = own.mapInArrow(_runs(length), "anchor long, doc_id long, start int, n int, hashes binary")
    ordered = runs.repartition("anchor").sortWithinPartitions("anchor", F.asc_nulls_first("doc_id"), "start")
    repeats = ordered.mapInArrow(_repeats, "doc_id long, start int, n int")
    marks = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))  # of one document
    marked = own.join(marks.withColumnRenamed("doc_id", "marked_id"), F.col("doc_id").eqNullSafe(F.col("marked_id")), "left")
    return marked.select("doc_id", "text", "marks").mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string")
