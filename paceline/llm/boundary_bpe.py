"""BPE encoding and decoding: words are cut where no vocabulary token can reach across, and the fragments encoded alone."""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
#: Distinct words and fragments whose ids a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 500_000, 48
#: Bytes up to which a fragment's pairs are looked through anew for each merge; longer ones keep them in a heap.
SHORT = 24
TOKEN_BITS = 24
TOKENS = (1 << TOKEN_BITS) - 1
#: Characters of texts whose ids and decoded texts leave a worker at once; a longer text leaves alone.
CHUNK = 4_000_000
#: Texts of characters below this are normalised and cut into words here, others by the library.
LATIN = 0x180


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Known(dict):
    """A bounded memory of ``make(key)``; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class BoundaryBpe:
    """``encode(text)`` and ``decode(ids)``, equal to the library's for a byte-level vocabulary with word ends.

    A merge joins two neighbours to a token of the vocabulary. Where two bytes stand next to each other in no token at
    all, no merge reaches across: that is a forced boundary, whatever stands around it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.plain = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        #: (left, right) to the merge's rank and, in the low bits, its token.
        self.merges = {(vocab[a], vocab[b]): rank << TOKEN_BITS | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        inside = np.zeros((256, 256), bool)
        for token in vocab:
            own = [byte_of[c] for c in token.removesuffix(self.suffix)]
            inside[own[:-1], own[1:]] = True
        self.forced = ~inside
        self.forced_rows = [bytes(row) for row in self.forced.astype(np.uint8)]
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)
        space = r"\t-\r \x85\xa0"
        #: The vocabulary's own pattern for words, its classes written out for the characters below LATIN.
        self.word_at = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^{space}{of('L')}{of('N')}]+")
        self.elsewhere = re.compile(f"[^\\x00-{chr(LATIN - 1)}]|İ")
        self.words = _Known(lambda word: array("i", self.word_ids(word.encode())).tobytes())
        self.spelt = str.maketrans({c: b for c, b in byte_of.items()})

    def cuts(self, word: bytes) -> list[int]:
        """Where the word is cut for certain: before each byte that follows its predecessor in no token."""
        if len(word) < 32:
            forced = self.forced_rows
            return [k for k, (a, b) in enumerate(zip(word, word[1:]), 1) if forced[a][b]]
        own = np.frombuffer(word, np.uint8)
        return (np.flatnonzero(self.forced[own[:-1], own[1:]]) + 1).tolist()

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of a word: those of its fragments, one after another; the last fragment carries the word's end."""
        cuts = self.cuts(word)
        if not cuts:
            return self._merged(word, True)
        edges = [0, *cuts, len(word)]
        return [i for a, z in zip(edges, cuts) for i in self._merged(word[a:z], False)] + self._merged(word[cuts[-1] :], True)

    def _merged(self, fragment: bytes, last: bool) -> list[int]:
        """The ids of one fragment: the merge of least rank first, of equal ones the leftmost; n log n steps."""
        ids = [self.plain[b] for b in fragment]
        if last:
            ids[-1] = self.final[fragment[-1]]
        n = len(ids)
        if n <= SHORT:
            none, of = 1 << 62, self.merges.get
            ranks = [of(pair, none) for pair in zip(ids, ids[1:])]
            while ranks and (least := min(ranks)) != none:
                k = ranks.index(least)
                ids[k : k + 2] = [least & TOKENS]
                del ranks[k]
                if k:
                    ranks[k - 1] = of((ids[k - 1], ids[k]), none)
                if k < len(ranks):
                    ranks[k] = of((ids[k], ids[k + 1]), none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[pair], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.merges]
        heapq.heapify(heap)
        while heap:
            least, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or self.merges.get((ids[k], ids[j])) != least:
                continue
            ids[k], ids[j] = least & TOKENS, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (found := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found, a))
        return [i for i in ids if i >= 0]

    def _words(self, text: str) -> list[str]:
        if not self.elsewhere.search(text):
            return self.word_at.findall(text.lower())
        made = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(ord, w.translate(self.spelt))).decode() for w, _ in made]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; the strings of special tokens are special tokens."""
        out = []
        for part in self.special_at.split(text or ""):
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            elif part:
                out += map(self.words.__getitem__, self._words(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the vocabulary with a space between them, special ones too: it names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.cache
def boundary_bpe(name: str = TOKENIZER) -> BoundaryBpe:
    """``name``: a file of the installed public tokenizers, or a path."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return BoundaryBpe(name)


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, ids (array of int), decoded (what the ids decode to).

    Whole texts are encoded where they are read, without a shuffle; a word's fragments are encoded once while a worker
    remembers them. Null and empty texts have no ids and decode to the empty text; null doc_ids and rows that repeat are
    encoded like any; a text, a word or a fragment may have any length. Other columns aren't read. No rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = boundary_bpe(tokenizer)
        for b in batches:
            texts, done = b.column("text"), 0
            while done < len(texts):
                ids, decoded, size, begun = [], [], 0, done
                while done < len(texts) and (size < CHUNK or done == begun):
                    text = texts[done].as_py()
                    ids.append(bpe.encode(text))
                    decoded.append(bpe.decode(ids[-1]))
                    size += len(text or "")
                    done += 1
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(begun, done - begun), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
