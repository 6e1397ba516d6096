"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import bits_for, n_words, written

#: Words that a document is served at once; longer documents queue as several quanta.
QUANTUM = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes(source, size)`` to one row per source: source, source_size, weight, target.

    Sources in code-point order, null last, take ``weights`` in turn and share ``budget`` times all sizes; none gets
    more than ``most`` times its own size, and what it would have had beyond is shared by weight among the others.
    Filling in order of ``most * size / weight`` has a closed form: the common level is the largest of the levels that
    result when the first k sources are full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    filled = Window.orderBy("full_at", F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    before = F.sum(F.lit(most) * F.col("source_size")).over(filled.rowsBetween(Window.unboundedPreceding, 0)) - F.lit(most) * F.col("source_size")
    left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level_k", (F.lit(float(budget)) * F.sum("source_size").over(whole) - before) / left)
    level = F.max("level_k").over(whole)
    target = F.least(F.lit(float(most)) * F.col("source_size"), level * F.col("weight"))
    return by.select("source", "source_size", "weight", target.alias("target"))


#: A row's place by its source and the hash bucket of its turn; null is a source of its own.
KEY = ["named", "known", "bucket"]


def _rows(docs: DataFrame, bits: int, *keep: str | Column) -> DataFrame:
    """source, size, the shuffled turn and the KEY of each row of ``docs``; null doc_ids are told apart by their texts."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string")))
    head = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(name).alias("turn"), *keep)
    return rows.withColumns({"named": F.coalesce("source", F.lit("")), "known": F.col("source").isNotNull(), "bucket": F.shiftright(head, 32 - bits) if bits else F.lit(0).cast("long")})


def _started(rows: DataFrame, offsets: DataFrame, *ties: str) -> DataFrame:
    """Where each row starts in its source's queue: sums of the buckets before, and of the rows before in its own.

    Rows are dealt out by KEY once, for the join and the window alike.
    """
    inside = Window.partitionBy(*KEY).orderBy("turn", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets.hint("merge"), KEY).withColumn("until", F.sum("size").over(inside))
    return placed.withColumn("start", F.col("base") + F.col("until") - F.col("size")).drop("until", "base", *KEY)


def _offsets(rows: DataFrame, weights: tuple[int, ...], budget: float, most: int) -> DataFrame:
    """One row per KEY: base (its source's words before it), source_size, target, total (all words)."""
    by = rows.groupBy("source", *KEY).agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("named", "known").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = by.select(*KEY, (F.sum("size").over(so_far) - F.col("size")).alias("base"))
    targets = source_targets(by, weights, budget, most)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))).alias("total")
    targets = targets.select(F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNotNull().alias("known"), "source_size", "target", total)
    return offsets.join(targets, ["named", "known"])


def queue(placed: DataFrame, budget: float, most: int, bits: int) -> DataFrame:
    """The mix's queue: ``placed`` rows' words by pass and quantum, in order of virtual finish time, cut at the budget.

    A document queues once for each pass, one of more than QUANTUM words as several quanta, as packets do. A quantum's
    virtual finish time is the source's words up to its end divided by the source's target. The queue is sorted over
    all sources: virtual time is cut into equal ranges, whose number grows with the rows and which hold about equal
    numbers of words as all sources are served at one speed; ranges are summed, the sums accumulated, and quanta
    sorted within their range only. ``served`` words of a quantum come before the budget is spent; the one at the cut
    counts in part.
    """
    share = F.when(F.col("target") > 0, F.col("target"))
    step = lambda: F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(QUANTUM).cast("long"))
    q = placed.where("size > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(most))))).withColumn("at", F.explode(step()))
    q = q.withColumn("words", F.least(F.lit(QUANTUM).cast("long"), F.col("size") - F.col("at")))
    q = q.withColumn("finish", (F.col("start") + F.col("pass") * F.col("source_size") + F.col("at") + F.col("words")) / share)
    q = q.withColumn("range", F.floor(F.col("finish") * (1 << bits)).cast("long"))
    ranges = q.groupBy("range").agg(F.sum("words").alias("n"))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row a range
    before = ranges.select("range", (F.sum("n").over(so_far) - F.col("n")).alias("before"))
    inside = Window.partitionBy("range").orderBy("finish", "source", "start", "pass", "at").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("until", F.sum("words").over(inside)).join(before, "range")
    left = F.floor(F.lit(float(budget)) * F.col("total")).cast("long") - F.col("before") - F.col("until") + F.col("words")
    return q.withColumn("served", F.least(F.col("words"), F.greatest(left, F.lit(0).cast("long")))).drop("until", "before", "range")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, rows_per_bucket: int = 2000) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, taken, virtual_finish.

    The documents of a source are shuffled by the MD5 of their doc_id and queue up to ``most`` times in that order. The
    queue of all sources is sorted by virtual finish time and truncated where the whole budget is spent (``queue``);
    ``taken`` counts a document's words before that, all passes together, so that a source's sum differs from its target
    by a quantum at most. Cumulative sums take two levels: sums by (source, hash bucket) are accumulated over buckets,
    and rows only within their bucket, whose number grows with the rows; a source with a third of all rows is many
    buckets. ``virtual_finish`` is that of the last quantum served, null for none. Null or blank texts have size 0 and
    taken 0; a null source is a source; null doc_ids queue by their text; rows that repeat are queued each; an empty
    table gives no rows; other columns aren't read. Reruns agree.
    """
    bits = bits_for(docs.count(), rows_per_bucket)
    rows = written(_rows(docs, bits), "sizes")
    placed = written(_started(rows, _offsets(rows, weights, budget, most)), "placed")
    q = queue(placed, budget, most, bits).where("served > 0")
    got = q.groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("served").alias("taken"), F.max("finish").alias("virtual_finish"))
    out = placed.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "virtual_finish")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, rows_per_bucket: int = 2000) -> DataFrame:
    """The documents the mix takes, with the columns of ``docs``, sorted by virtual finish time over the whole mix.

    A document is a row for every pass of which at least half of its words come before the queue's cut, so at most
    ``most`` rows, each row of ``docs`` by itself, whatever its doc_id. Documents of no words cost nothing and stay
    once. The documents travel with their place in the queue, so nothing is joined by doc_id.
    """
    bits = bits_for(docs.count(), rows_per_bucket)
    small = written(_rows(docs, bits), "sizes")
    offsets = written(_offsets(small, weights, budget, most), "offsets")
    q = queue(_started(small, offsets), budget, most, bits)
    cut = q.where("served > 0").agg(F.coalesce(F.max("finish"), F.lit(0.0)).alias("cut"))
    names = [F.col("row")[c].alias(c) for c in docs.columns]
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))  # as one column: no name can clash
    rows = _rows(rows, bits, "row", F.xxhash64("text").alias("tie"))
    placed = _started(rows, offsets, "tie").join(F.broadcast(cut))  # one row
    share = F.when(F.col("target") > 0, F.col("target"))
    at = lambda e, part: (F.col("start") + e * F.col("source_size") + F.col("size") * part) / share
    times = F.array_compact(F.array(*[F.when(at(e, 0.5) <= F.col("cut"), at(e, 1.0)) for e in range(most)]))
    times = F.when(F.col("size") == 0, F.array(F.lit(0.0))).otherwise(times)
    return placed.select("row", "doc_id", "tie", F.explode(times).alias("at")).orderBy("at", "doc_id", "tie").select(*names)
