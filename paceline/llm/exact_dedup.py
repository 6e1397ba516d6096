"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id of each group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import lower_ascii, written

_SCHEMA = "doc_id long, content_key binary, text_sha256 string"
#: Parts that the rows of one text are dealt to.
SALTS = 64


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(x or "").encode().lower() for x in b.column("text").to_pylist()]
        columns = [b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        names = ["doc_id", "content_key", "text_sha256"]
        if "body" in b.schema.names:
            columns.append(b.column("body"))
            names.append("body")
        yield pa.RecordBatch.from_arrays(columns, names)


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty. ``keep`` names which doc_id of a
    group stays, ``max`` or ``min``. The hash is aggregated map-side, so a group of any size is one row per task; the
    bytes of the members of groups of two and more are then compared with those of the row that stays, and members
    that differ (a collision of the hash) are grouped by SHA-256 instead. Rows that repeat a doc_id with equal text
    share one verdict. A null doc_id never wins over another; a group of nulls keeps null. An empty table gives an
    empty result. Columns other than doc_id and text are not read, so none can clash.
    """
    best = F.max if keep == "max" else F.min
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = written(_salted(own.mapInArrow(_fingerprint, _SCHEMA)), "fingerprints")
    groups = _verdicts(prints, best, "content_key").where("group_size > 1")
    bodies = _salted(own.withColumn("body", F.coalesce("text", F.lit(""))).mapInArrow(_fingerprint, f"{_SCHEMA}, body string"))
    several = written(bodies.join(groups, ["content_key", "salt"]), "exact-members")
    winners = several.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("content_key").agg(F.first("body").alias("won"))
    winners = winners.join(several.select("content_key", "salt").distinct(), "content_key")  # at most SALTS rows a group
    same = (F.col("body") == F.col("won")) | (lower_ascii(F.col("body")) == lower_ascii(F.col("won")))
    collided = written(several.join(winners, ["content_key", "salt"]).where(~same).select("content_key", "text_sha256").distinct(), "exact-collisions")
    apart = F.lit("")
    if collided.take(1):
        prints = prints.join(collided.withColumn("alone", F.lit(True)), ["content_key", "text_sha256"], "left")
        apart = F.when(F.col("alone"), F.col("text_sha256")).otherwise(apart)
    marked = prints.withColumn("apart", apart)
    out = marked.join(_verdicts(marked, best, "content_key", "apart"), ["content_key", "apart", "salt"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _salted(prints: DataFrame) -> DataFrame:
    return prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(SALTS)).cast("int"))


def _verdicts(rows: DataFrame, best, *key: str) -> DataFrame:
    """keep_id and group_size of each key, a row for each salt that it has: a group is counted by (key, salt), then by
    key, and its rows meet their verdict by (key, salt), so that no task has all rows of a group."""
    parts = rows.groupBy(*key, "salt").agg(best("doc_id").alias("keep"), F.count("*").alias("n"))
    whole = parts.groupBy(*key).agg(best("keep").alias("keep_id"), F.sum("n").alias("group_size"))
    return parts.select(*key, "salt").join(whole, list(key))
