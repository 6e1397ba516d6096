"""Token-id output: best-fit-decreasing packing with a segment tree, packed id matrices and their segment tables."""

from __future__ import annotations

import array
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.tokens import TOKENIZER, encoder

CAPACITY = 2048
END = 1
PAD = 0
#: A packing pool closes at this many tokens: memory of a task is bounded, whatever the size of its partition.
POOL_TOKENS = 2_000_000


class CapacityTree:
    """Open bins by what is left in them; finds the least that suffices in one descent of a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, by: int) -> None:
        i = self.size + left
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, b: int, left: int) -> None:
        self.bins[left].append(b)
        self._add(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least capacity of ``need`` or more, taken out; None if there is none."""
        i, count = self.size + need, self.count
        while not count[i]:
            while i & 1:  # right children have nothing further right under their parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        left = i - self.size
        self._add(left, -1)
        return self.bins[left].pop(), left


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into ``lengths`` (each 1 to ``capacity``); longest first, each to the fullest bin it fits in."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        b, left = found if found else (len(bins), capacity)
        if not found:
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            tree.put(b, left - lengths[i])
    return bins


_SCHEMA = "pool string, row long, input_ids binary, n_tokens long, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, starts array<bigint>, ids_crc32 long"


def _rows(name: str, capacity: int, digest: bool) -> Callable:
    def flush(pool: str, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        out: list[tuple] = []
        for b in best_fit_decreasing([len(p[2]) // 4 for p in parts], capacity):
            mine = sorted((parts[i] for i in b), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
            ids = b"".join(p[2] for p in mine)
            edges = [0]
            for p in mine:
                edges.append(edges[-1] + len(p[2]) // 4)
            n = edges[-1]
            whole = ids + PAD.to_bytes(4, "little") * (capacity - n)
            resets = array.array("I", [k for a, z in zip(edges, edges[1:]) for k in range(z - a)]) if not digest else array.array("I")
            out.append((pool, len(out), None if digest else whole, n, edges, None if digest else resets.tobytes(), [p[0] for p in mine], [p[1] for p in mine], zlib.crc32(whole)))
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(name), END.to_bytes(4, "little")
        task = TaskContext.get()
        part, pools = task.partitionId() if task else 0, 0
        parts: list[tuple[int, int, bytes]] = []
        held = 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc.ids(text or "") + tail
                for at in range(0, len(ids), 4 * capacity):
                    parts.append((doc, at // 4, ids[at : at + 4 * capacity]))
                held += len(ids) // 4
                if held >= POOL_TOKENS:
                    yield flush(f"{part}-{pools}", parts)
                    parts, held, pools = [], 0, pools + 1
        if parts:
            yield flush(f"{part}-{pools}", parts)

    return run


def packed_rows(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """Rows of packed id matrices of ``docs(doc_id, text)``.

    A document is its ids and then END; one longer than ``capacity`` is split without loss. Pools of POOL_TOKENS
    tokens are packed where they are read, by best fit decreasing, with no shuffle; a lost executor's tasks are just
    run anew, and a pool's name (partition and number in it) is its own, whatever names documents have. Reruns over the
    same partitions agree; other partitions make other pools. A row: input_ids (``capacity`` little-endian unsigned 32-bit ids, padded with PAD), n_tokens,
    cu_seqlens (cumulative segment lengths from 0), position_ids (from 0 in each segment), doc_ids and starts of its
    segments, ids_crc32 of input_ids. ``digest`` leaves input_ids and position_ids null. Null texts are empty
    documents; null doc_ids are kept as null; an empty table gives no rows; rows that repeat are packed as often.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(_rows(tokenizer, capacity, digest), _SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed matrices as a Parquet table of binary rows."""
    packed_rows(docs, **options).write.parquet(path)
