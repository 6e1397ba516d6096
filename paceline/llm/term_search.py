"""Ranked lexical search: TPUT over postings by term, heads for a lower bound, a uniform threshold, exact look-ups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import union_all, written

#: Documents returned for an item.
TOP = 20
#: Terms, or (item, term) rows, that are sent to every task at once; more go in several blocks.
SENT = 200_000
#: Postings, and documents, of one block, whose lists meet in one task.
POSTINGS, DOCUMENTS = 1_000_000, 16_384
#: All bytes but letters, digits and those of other than ASCII characters separate terms; A-Z are lower-cased.
_KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, with repeats."""
    return (text or "").encode().translate(_KEPT).split()


def _ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The TOP rows by ``order`` of each ``by``; each task keeps its own TOP of them before they meet."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= TOP)


def item_terms(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to (item, item_id, term, q): a row for each distinct term of each distinct row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(item, i, t, q) for item, i, text in zip(*(b.column(c).to_pylist() for c in ("item", "item_id", "text"))) for t, q in Counter(terms(text)).items()]
            for k in range(0, len(rows), POSTINGS):
                cols = list(zip(*rows[k : k + POSTINGS]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.int64()))], ["item", "item_id", "term", "q"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    own = own.withColumn("item", F.unhex(F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"), 256)))
    return own.mapInArrow(run, "item binary, item_id long, term binary, q long")


_LIST = "block long, term int, rows array<int>, tfs array<long>, sizes array<long>, doc_ids array<long>"
_LIST_TYPES = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
_LIST_NAMES = [c.split()[0] for c in _LIST.split(", ")]


def _listed(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``docs(doc_id, text)`` to the posting lists of the ``vocabulary`` by block of documents: a row for each (block,
    term), with the document's number in its block, the term's occurrences there and the document's length. A row of
    term -1 has the doc_ids and lengths of all the block's documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, block = sent.value.get, TaskContext.get().partitionId() << 33
        lists: dict[int, tuple[list, list, list]] = {}
        doc_ids, lengths, size = [], [], 0

        def made() -> pa.RecordBatch:
            rows = [(block, -1, None, None, lengths, doc_ids), *((block, t, r, tf, n, None) for t, (r, tf, n) in lists.items())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LIST_TYPES)], _LIST_NAMES)

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ws = terms(text.as_py())
                found = Counter(map(ids, ws))
                found.pop(None, None)
                for t, tf in found.items():
                    rows, tfs, sizes = lists.setdefault(t, ([], [], []))
                    rows.append(len(doc_ids))
                    tfs.append(tf)
                    sizes.append(len(ws))
                doc_ids.append(i)
                lengths.append(len(ws))
                size += len(found)
                if size >= POSTINGS or len(doc_ids) >= DOCUMENTS:
                    yield made()
                    lists, doc_ids, lengths, size, block = {}, [], [], 0, block + 1
        if doc_ids:
            yield made()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(run, _LIST)


def build_index(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The posting lists of the ``wanted`` terms, a written table, (id, term, w), and the numbers of documents and terms.

    The terms are sent to the tasks in blocks of about SENT, each a pass over the documents.
    """
    spark, n = docs.sparkSession, wanted.count()
    blocks = -(-n // SENT) or 1
    parts, names, begun = [], [], 0
    for k in range(blocks):
        own = {bytes(r["term"]): begun + i for i, r in enumerate(wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect())}
        begun += len(own)
        names.append(spark.createDataFrame([(t, i) for t, i in own.items()], "id_term binary, id int").withColumnRenamed("id_term", "term"))
        parts.append(written(_listed(docs, own), "lists"))
    whole = F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)
    total = parts[0].where("term = -1").select(F.size(F.filter("sizes", lambda x: x > 0)).alias("n"), whole.alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    lists = union_all([parts[0], *(p.where("term >= 0") for p in parts[1:])])
    df = lists.where("term >= 0").groupBy(F.col("term").alias("id")).agg(F.sum(F.size("rows")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    return lists, written(union_all(names).join(df, "id").select("id", "term", weight.alias("w")), "term-weights"), n_docs, n_terms


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds for each unit of its weight to documents of so many terms that hold it so often."""
    m = 75 + (25 * size * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _heads(lists: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The head of each term's whole list, TOP postings: (term, impact, block, row). Each block's list gives its own head first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            counts = b.column("rows").value_lengths().to_numpy(zero_copy_only=False)
            impact = impacts(_flat(b.column("tfs")), _flat(b.column("sizes")), n_docs, n_terms)
            at = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((-impact, at))
            first = order[np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) < TOP]
            pick = lambda c: b.column(c).take(pa.array(at[first]))
            yield pa.RecordBatch.from_arrays([pick("term"), pa.array(impact[first], pa.int64()), pick("block"), pa.array(_flat(b.column("rows"))[first], pa.int32())], ["term", "impact", "block", "row"])

    own = lists.where("term >= 0").select("term", "block", "rows", "tfs", "sizes")
    return _ranked(own.mapInArrow(run, "term int, impact long, block long, row int"), ["term"], F.col("impact").desc(), F.col("block"), F.col("row")).drop("rank")


_FOUND = "item binary, score long, doc_id long, block long, row int"
_FOUND_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def block_best(lists: pa.Table, items: list[tuple], n_docs: int, n_terms: int) -> list[tuple]:
    """(item, score, doc_id, block, row) of a block's documents that may be among an item's TOP: TOP of each item at most.

    ``items``: (item, bound, threshold, [(term, value, cap)]). Every list of an item is fetched as far as its threshold.
    A document's sum of that, with the cap of each list in which it wasn't fetched, must reach the bound, and the TOP-th
    largest sum of what was fetched here; those that do get what they have in the lists' rests, and so their exact scores.
    """
    block, held, names = None, {}, []
    for block, term, rows, tfs, sizes, doc_ids in zip(*(lists.column(c) for c in _LIST_NAMES)):
        if term.as_py() < 0:
            block, names = block.as_py(), doc_ids.as_py()
        else:
            one = lambda a: a.values.to_numpy(zero_copy_only=False)
            impact = impacts(one(tfs), one(sizes), n_docs, n_terms)
            order = np.argsort(-impact, kind="stable")
            held[term.as_py()] = (one(rows)[order], impact[order])
    by_name = np.empty(len(names), np.int64)
    by_name[sorted(range(len(names)), key=lambda k: (names[k] is None, names[k] or 0, k))] = np.arange(len(names))
    out = []
    for item, bound, threshold, wanted in items:
        total = np.zeros(len(names), np.int64)
        missed = np.full(len(names), sum(cap for *_, cap in wanted))
        rests = []
        for term, value, cap in wanted:
            if term in held:
                rows, impact = held[term]
                cut = np.searchsorted(-impact, -(-(-threshold // value)), side="right")  # impact >= threshold / value
                total[rows[:cut]] += value * impact[:cut]
                missed[rows[:cut]] -= cap
                rests.append((rows[cut:], value * impact[cut:]))
        fetched = np.flatnonzero(total)
        if len(fetched) > TOP:
            bound = max(bound, int(np.partition(total[fetched], -TOP)[-TOP]))
        close = np.zeros(len(names), bool)
        close[fetched] = total[fetched] + missed[fetched] >= bound
        for rows, more in rests:
            stays = close[rows]
            total[rows[stays]] += more[stays]
        found = np.flatnonzero(close)
        found = found[np.lexsort((by_name[found], -total[found]))[:TOP]]
        out += [(item, int(total[k]), names[k], block, int(k)) for k in found]
    return out


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP documents of each item: (item_id, rank, doc_id, score), by falling score, then doc_id.

    1. The heads of all terms' lists, TOP postings each, are summed by item and document: the TOP-th sum bounds the
    score of an item's last rank from below. 2. That bound divided by the item's number of lists is the threshold for
    every one of its lists: a document under it in all of them can't reach the bound. Lists are fetched that far, block
    of documents by block, with the threshold or the list's maximum for what wasn't fetched; documents that can't reach
    the bound leave. 3. The others look up what they have in the rests of the lists: their exact scores, of which each
    block gives TOP for an item at most. An item with fewer than TOP documents in its heads has the bound 0 and reads
    its whole lists. Lists are shuffled once, by block, and a frequent term's list lies in as many blocks as there are.

    Every row of ``docs`` is a document, also rows that repeat a doc_id; null doc_ids come last among equal scores. Null
    and empty texts hold no term; items without terms, or whose terms no document holds, get no rows. Rows of ``items``
    that repeat as a whole are one item. Other columns aren't read. Empty tables give no rows.
    """
    asked = written(item_terms(items), "item-terms")
    lists, weights, n_docs, n_terms = build_index(docs, asked.select("term").distinct())
    heads = written(_heads(lists, n_docs, n_terms), "heads")
    most = heads.groupBy("term").agg(F.max("impact").alias("most"))
    value = (F.col("q") * F.col("w")).alias("value")
    valued = written(asked.join(weights.hint("merge"), "term").where("w > 0").select("item", F.col("id").alias("term"), value).join(most.hint("merge"), "term"), "item-values")
    sums = heads.join(valued.hint("merge"), "term").groupBy("item", "block", "row").agg(F.sum(F.col("value") * F.col("impact")).alias("low"))
    bound = _ranked(sums, ["item"], F.col("low").desc()).groupBy("item").agg(F.when(F.count("*") == TOP, F.min("low")).otherwise(0).alias("bound"))
    size = valued.groupBy("item").agg(F.count("*").alias("m")).join(bound.hint("merge"), "item")
    size = size.select("item", "bound", F.greatest(F.expr("(bound + m - 1) div m"), F.lit(1)).alias("threshold"))
    cap = F.least(F.col("threshold") - 1, F.col("value") * F.col("most"))
    ready = valued.join(size.hint("merge"), "item").groupBy("item", "bound", "threshold").agg(F.collect_list(F.struct("term", "value", cap.alias("cap"))).alias("wanted"))
    ready = written(ready, "items-ready")
    n = valued.count()
    blocks = -(-n // SENT) or 1
    found = []
    for k in range(blocks):
        own = [(bytes(r["item"]), r["bound"], r["threshold"], [tuple(x) for x in r["wanted"]]) for r in ready.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]
        found.append(lists.groupBy("block").applyInArrow(_best(docs.sparkSession.sparkContext.broadcast(own), n_docs, n_terms), _FOUND))
    best = _ranked(union_all(found), ["item"], F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block"), F.col("row"))
    names = asked.select("item", "item_id").distinct()
    return best.join(names.hint("merge"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _best(sent, n_docs: int, n_terms: int) -> Callable:
    def run(lists: pa.Table) -> pa.Table:
        found = block_best(lists, sent.value, n_docs, n_terms) if n_terms else []
        cols = zip(*found) if found else [[]] * len(_FOUND_TYPES)
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, _FOUND_TYPES)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run
