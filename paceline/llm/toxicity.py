"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared window by window.

There are two pairs of them: one of each class's own text as it stands, which tells classes apart by phrases, and one
that differs in the words that only toxic documents have, for classes that differ in few words.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fitting uses at most so many labelled documents of either class, and so many characters of them.
TOXIC_DOCS, CLEAN_DOCS, TOXIC_CHARS, CLEAN_CHARS = 4000, 6000, 5_000_000, 12_000_000
#: Words of a window.
WINDOW = 8
#: Bytes of ordinary text that both dictionaries hold, and of toxic text that the toxic one holds besides.
SHARED, OWN = 98_304, 12_288
#: Words of a segment of the shared text, and of a toxic segment to either side of its word.
SEGMENT, BESIDE = 4, 1
#: A toxic word occurs in this share of the toxic documents at least, and so many times as often as in ordinary ones.
SHARE, RATIO = 0.004, 12.0
#: Bytes of the shortest match: less than a word says nothing about a class.
MATCH = 4
#: Lengths at which a word's beginning counts as a word, its leading space included.
STEMS = (5, 6, 7, 9)
#: A window's saving in bytes enters a document's features as one of these, or the last for more.
SAVINGS = (1, 2, 3, 4, 5, 6, 7, 8)
#: Bytes of either dictionary of a class's own text, words of its segments, and of the windows that are compared by them.
CLASS, PIECE, SPAN = 131_072, 8, 24
#: Ends both dictionaries of that pair and every window.
TAIL = b" of the and in that "
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a whole text between white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def spoken(text: str | None) -> list[bytes]:
    """What dictionaries are made of: the runs of letters of a text, A-Z lower-cased, without signs and digits."""
    return _LETTERS.findall((text or "").encode().lower())


def windows(ws: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """A text's windows: ``size`` words each, the last one what is left. Every word is in one."""
    for k in range(0, len(ws), size):
        yield b" " + b" ".join(ws[k : k + size]) + b" "


def _parts(w: bytes) -> set[bytes]:
    w = b" " + w
    return {w + b" "} | {w[:n] for n in STEMS if len(w) > n}


def _contexts(docs: Iterable[list[bytes]]) -> Counter:
    """In how many different contexts (the word before) each word or beginning occurs: copies of a document count once."""
    seen: set[int] = set()
    out: Counter = Counter()
    for ws in docs:
        for before, w in zip([b"", *ws], ws):
            key = hash((before, w))
            if key not in seen:
                seen.add(key)
                out.update(_parts(w))
    return out


def _covering(docs: Iterable[list[bytes]], gain: Counter, size: int, used: set[bytes]) -> bytes:
    """Segments of the documents' texts, ``size`` bytes at most: as dictionary trainers do, those whose words gain most
    come in and each word counts once; the most gaining stand last, nearest to what is compressed. ``used`` grows."""
    best: list[tuple[int, list[bytes]]] = []
    for ws in docs:
        for k in range(0, len(ws), SEGMENT):
            piece = ws[k : k + SEGMENT]
            best.append((sum(gain[w] for w in set(piece)), piece))
        best = heapq.nlargest(30_000, best, key=lambda x: x[0]) if len(best) > 100_000 else best
    heap = [(-g, k) for k, (g, _) in enumerate(best)]
    heapq.heapify(heap)
    out, n = [], 0
    while heap and n < size:
        old, k = heapq.heappop(heap)
        new = sum(gain[w] for w in set(best[k][1]) - used)
        if not new:
            continue
        if heap and new < -heap[0][0]:
            heapq.heappush(heap, (-new, k))
            continue
        used.update(best[k][1])
        out.append(b" " + b" ".join(best[k][1]))
        n += len(out[-1])
    return b"".join(reversed(out))[-size:] + b" "


def _around(docs: Iterable[list[bytes]], toxic: Counter, plain: set[bytes], size: int) -> bytes:
    """Segments of toxic texts around the ``toxic`` words, the most frequent last: a word with the words beside it
    that ``plain`` text has too, as others would be taken for a sign of the class. The longest such segment is taken."""
    place: dict[bytes, bytes] = {}
    for ws in docs:
        for k, w in enumerate(ws):
            if w in toxic:
                a = next((j for j in range(k, max(k - BESIDE, 0), -1) if ws[j - 1] not in plain), max(k - BESIDE, 0))
                z = next((j for j in range(k + 1, min(k + 1 + BESIDE, len(ws))) if ws[j] not in plain), min(k + 1 + BESIDE, len(ws)))
                piece = b" " + b" ".join(ws[a:z])
                if len(piece) > len(place.get(w, b"")):
                    place[w] = piece
    out, n = [], 0
    for w, _ in sorted(toxic.items(), key=lambda x: (-x[1], x[0])):
        if n + len(place[w]) > size:
            break
        out.append(place[w])
        n += len(place[w])
    return b"".join(reversed(out)) + b" "


def _own_text(docs: Iterable[str | None], rng: random.Random) -> list[bytes]:
    """Different segments of the documents' texts as they stand, in random order: copies count once."""
    pieces = sorted({b" " + b" ".join(ws[k : k + PIECE]) for ws in map(words, docs) for k in range(0, len(ws), PIECE)})
    rng.shuffle(pieces)
    return pieces


def _class_dictionaries(ordinary: Iterable[str | None], toxic: Iterable[str | None]) -> tuple[bytes, bytes]:
    """Both classes' own text, of equal size: CLASS bytes, or as many as the smaller class has."""
    rng = random.Random(0)
    pieces = [_own_text(ordinary, rng), _own_text(toxic, rng)]
    size = min(CLASS, *(sum(map(len, p)) for p in pieces))
    ordinary, toxic = (b"".join(p)[:size] + TAIL for p in pieces)
    return ordinary, toxic


def _compressor(body: bytes) -> Callable[[bytes], bytes]:
    p = zstandard.ZstdCompressionParameters(compression_level=3, min_match=MATCH, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=18)
    d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress


@dataclass
class Model:
    """Two pairs of dictionaries and the calibration; a plain value that goes to the executors as it is."""

    toxic: bytes
    ordinary: bytes
    tail: bytes
    weights: list[float]
    own_toxic: bytes = TAIL
    own_ordinary: bytes = TAIL

    def __getstate__(self):
        return {**self.__dict__, "_both": None, "_own": None}

    def distances(self, ws: list[bytes]) -> list[float]:
        """What the windows' distances to both classes' own text are like: bytes shorter by the toxic one's, mean, spread,
        most and the share of far ones. None of these grows with a text as sums do: long texts are like short ones."""
        if getattr(self, "_own", None) is None:
            self._own = (_compressor(self.own_ordinary), _compressor(self.own_toxic))
        plain, toxic = self._own
        d = np.sort([len(plain(w)) - len(toxic(w)) for w in (w + TAIL for w in windows(ws, SPAN))] or [0.0])
        return [float(d.mean()), float(d.std()), float(d[-1]), float(d[-3:].mean()), float((d > 4).mean())]

    def saving(self, window: bytes) -> int:
        """Bytes that a window compresses shorter by the toxic dictionary than by the ordinary one.

        A tail that both dictionaries hold follows the window: what a frame costs anyway is equal then, and the window
        isn't in a frame's last bytes, where no match begins.
        """
        if getattr(self, "_both", None) is None:
            self._both = (_compressor(self.ordinary), _compressor(self.toxic))
        whole = window + self.tail
        return len(self._both[0](whole)) - len(self._both[1](whole))

    def features(self, text: str | None) -> list[float]:
        ws = words(text)
        counts = Counter(min(s, SAVINGS[-1]) for s in map(self.saving, windows(ws)) if s >= SAVINGS[0])
        per = max(len(ws), 1)
        own = [math.log1p(len(ws))] + [math.log1p(counts[s]) for s in SAVINGS] + [math.log1p(1000 * counts[s] / per) for s in SAVINGS]
        return [1.0, *own, *self.distances(ws)]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, self.features(text))) if self.weights else 0.0
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Newton's method for the penalised likelihood of columns on one scale; the first, the constant, isn't penalised."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0.0, 1.0
    sd[sd < 1e-9] = 1.0
    x = (x - mean) / sd
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w /= sd
    w[0] -= w[1:] @ mean[1:]
    return w.tolist()


def fit(rows: list[tuple[str | None, int]], share: float | None = None) -> Model:
    """A model of (text, 0 or 1) rows. Three fifths train the dictionaries, the others calibrate the score, weighed so
    that ``share`` of them is toxic, as of all labelled documents: a sample of the classes has another share."""
    train: dict[int, list[str | None]] = {0: [], 1: []}
    rest = []
    for k, (text, toxic) in enumerate(rows):
        train[int(toxic)].append(text) if k % 5 < 3 else rest.append((text, int(toxic)))
    own = lambda v: map(spoken, train[v])
    found = {v: _contexts(own(v)) for v in (0, 1)}
    n = {v: len(train[v]) + 1 for v in (0, 1)}
    chosen = {s for s, c in found[1].items() if c >= max(4, SHARE * n[1]) and (c + 0.5) / n[1] >= RATIO * (found[0][s] + 0.5) / n[0]}
    toxic: Counter = Counter()
    for w in {w for ws in own(1) for w in ws}:
        if _parts(w) & chosen:
            toxic[w] = found[1][b" " + w + b" "]
    common: Counter = Counter()
    for ws in own(0):
        common.update(set(ws))
    used: set[bytes] = set()
    shared = _covering(own(0), common, SHARED, used) if common else b" the of and to in "
    model = Model(_around(own(1), toxic, used, OWN) + shared, shared, shared[-60:], [])
    model.own_ordinary, model.own_toxic = _class_dictionaries(train[0], train[1])
    y = np.array([t for _, t in rest], float)
    if 0 < y.sum() < len(y):
        share = y.mean() if share is None else share
        model.weights = _logistic(np.array([model.features(t) for t, _ in rest]), y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    elif len(y):
        model.weights = [8.0 if y[0] else -8.0] + [0.0] * (len(model.features("")) - 1)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled documents whose crc32(doc_id as text) mod 5 isn't 0: a bounded sample by hash."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    turn = F.xxhash64("doc_id")
    some = marks.where("toxic = 1").orderBy(turn, "doc_id").limit(TOXIC_DOCS).unionByName(marks.where("toxic = 0").orderBy(turn, "doc_id").limit(CLEAN_DOCS))
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), turn.alias("turn"), "doc_id")
    one = got.repartition(1).sortWithinPartitions("turn", "doc_id", "text").select("text", "toxic")  # a bounded number of documents
    made = one.mapInArrow(_fitted(marks.agg(F.avg("toxic")).first()[0]), "toxic binary, ordinary binary, tail binary, weights array<double>, own_toxic binary, own_ordinary binary").first()
    return fit([]) if made is None else Model(bytes(made["toxic"]), bytes(made["ordinary"]), bytes(made["tail"]), list(made["weights"]), bytes(made["own_toxic"]), bytes(made["own_ordinary"]))


def _fitted(share: float | None) -> Callable:
    """A model of the rows, of either class as many as there is room for: in a task, so that the driver has the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, rows = {1: TOXIC_CHARS, 0: CLEAN_CHARS}, []
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                if len(text or "") <= room[toxic]:
                    room[toxic] -= len(text or "")
                    rows.append((text, toxic))
        m = fit(rows, share)
        one = {"toxic": m.toxic, "ordinary": m.ordinary, "tail": m.tail, "weights": m.weights, "own_toxic": m.own_toxic, "own_ordinary": m.own_ordinary}
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64()) if n == "weights" else pa.binary()) for n, v in one.items()], list(one))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, score: whole texts, all windows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(x) for x in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def rejected(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores ``threshold`` or more; scored where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m.score(x) < threshold for x in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    Of the first pair of dictionaries each holds its class's own text, segments taken at random: a text's windows of SPAN
    words are compressed with both, and what the differences in length are like enters the score. Of the second pair both
    hold the same ordinary text, the toxic one besides the segments around the words that occur in many contexts of toxic
    documents and hardly in ordinary ones; of windows of WINDOW words, how many are shorter by how many bytes enters. In
    either kind of windows every word is once. A logistic fit on labelled documents that the dictionaries haven't seen
    calibrates both to a score. Fitting takes a sample by hash, bounded in documents and characters by the parameters
    above; documents that don't fit into what is left are skipped. Null and empty
    texts have no windows and get the score of a text without signal; very long ones are scored whole; rows that repeat
    score the same. A null doc_id counts as held out. Without labels of both classes the score is that of the only
    class, or 0.5. Scores depend on the text alone; an empty table gives no rows.
    """
    scored = score(docs, fit_on(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
