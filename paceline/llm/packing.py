"""Harmonic packing of token pieces into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import bits_for, written
from paceline.llm.tokens import TOKENIZER, encoder

CAPACITY = 2048
#: Document ends are marked by this id.
END = 1
#: Pieces are cut to powers of two down to this length; what is left is a last piece, whose class rounds up to GRAIN.
LEAST, GRAIN = 64, 4


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: whole sequences, falling powers of two, the rest."""
    start = 0
    while n - start >= capacity:
        yield start, capacity
        start += capacity
    size = capacity // 2
    while size >= least:
        if n - start >= size:
            yield start, size
            start += size
        size //= 2
    if n > start:
        yield start, n - start


def per_bin(length: int, capacity: int = CAPACITY, least: int = LEAST, grain: int = GRAIN) -> int:
    """The class of a piece: how many of its kind a sequence holds, the reciprocal of the share of the capacity."""
    return capacity // (length if length >= least else -(-length // grain) * grain)


def _pieces(name: str, capacity: int, end: int | None, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        tail = b"" if end is None else end.to_bytes(4, "little")
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "per_bin", "ids")}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc.ids(text or "") + tail
                n = len(ids) // 4
                for start, length in cuts(n, capacity):
                    part = ids[4 * start : 4 * (start + length)]
                    for k, v in zip(out, (doc, start, length, zlib.crc32(part), n, per_bin(length, capacity), part if with_ids else None), strict=True):
                        out[k].append(v)
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int | None = END, with_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` tokenised and cut, as a written table: doc_id, start, length, ids_crc32, doc_tokens, per_bin, ids."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    made = own.mapInArrow(_pieces(tokenizer, capacity, end, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, per_bin int, ids binary")
    return written(made, "token-pieces")


def harmonic_pack(pieces: DataFrame, rows_per_bucket: int = 5000) -> DataFrame:
    """``pieces(doc_id, start, length, per_bin, ...)`` with sequence_id and offset.

    Pieces are partitioned into reciprocal-capacity classes, and every sequence of a class takes a fixed number of its
    pieces, so the sequence of a piece is its rank in the class divided by that number. Ranks come from counts by
    (class, hash bucket), accumulated over the buckets, and from row numbers within a bucket: workers place their
    pieces independently, no search and no state goes between them, and only the last sequence of a class is short.
    Rows that repeat a doc_id are packed as often as they come. An empty table gives no rows.
    """
    rows = pieces.withColumn("__turn", F.xxhash64("doc_id", "start"))
    bits = bits_for(pieces.count(), rows_per_bucket)
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("__turn", 64 - bits) if bits else F.lit(0).cast("long"))
    by = rows.groupBy("per_bin", "__bucket").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("per_bin").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    base = by.withColumn("__base", F.sum("n").over(so_far) - F.col("n")).select("per_bin", "__bucket", "__base")
    classes = by.groupBy("per_bin").agg(F.sum("n").alias("n")).withColumn("bins", F.ceil(F.col("n") / F.col("per_bin")).cast("long"))
    before = Window.orderBy("per_bin").rowsBetween(Window.unboundedPreceding, 0)
    first = classes.select("per_bin", (F.sum("bins").over(before) - F.col("bins")).alias("__first"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("per_bin", "__bucket").orderBy("__turn", "doc_id", "start", "length")) - 1)
    ranked = ranked.join(base, ["per_bin", "__bucket"]).join(F.broadcast(first), "per_bin")  # a row a class, at most the capacity
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__base"))
    ranked = ranked.withColumn("sequence_id", (F.col("__first") + F.floor(F.col("__rank") / F.col("per_bin"))).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("__turn", "__bucket", "__base", "__first", "__rank")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Documents to packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    A document (null text: empty) is its ids and then END; each id lies in exactly one piece. Documents longer than
    the capacity fill whole sequences; the remainder is cut to powers of two, which fill sequences without padding,
    and a rest under LEAST tokens. Null doc_ids are packed like others.
    """
    packed = harmonic_pack(token_pieces(docs, tokenizer, capacity, END, with_ids))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
