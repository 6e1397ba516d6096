"""Search, BPE and vector codes against brute force, and on nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from paceline.llm import boundary_bpe, term_search, vector_codes

DOCS = "doc_id long, text string, score int, term string, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 3, "y") for i, t in rows], "item_id long, text string, q int, item string")


def own_terms(text):
    out, now = [], ""
    for c in text or "":
        if ord(c) >= 128 or c.isalnum():
            now += c.lower() if c.isascii() else c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def brute_search(documents, wanted, top=20):
    held = [(i, Counter(own_terms(t)), len(own_terms(t))) for i, t in documents]
    n_all, l_all = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(wanted):
        scores = []
        for k, (i, c, n) in enumerate(held):
            m = 75 + (25 * n * n_all) // max(l_all, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(own_terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, k))
        out += [(item, r, None if null else i, -s) for r, (s, null, i, _) in enumerate(sorted(scores)[:top], 1)]
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("sent", [200_000, 40])
def test_search(spark, monkeypatch, sent):
    """Frequent and rare terms, more documents of one score than ranks, items with few documents; terms sent in several blocks."""
    monkeypatch.setattr(term_search, "SENT", sent)
    rng = random.Random(1)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    rows = [(k, " ".join(word() for _ in range(rng.choice([3, 20, 60, 200])))) for k in range(400)]
    rows += [(1000 + k, "Same, tie! ever w1") for k in range(50)] + [(None, "same tie ever w1"), (None, None), (2000, None), (2001, ""), (2002, " .,;\n"), (7, "one w2 w2 twice"), (7, "one w2 w2 twice")]
    rows += [(3000, "é É ü-straße x_y A1b2 日本 " + "longword" * 5000), (3001, " ".join(word() for _ in range(30_000)))]
    wanted = [(k, " ".join(word() for _ in range(rng.choice([1, 5, 30])))) for k in range(20)]
    wanted += [(100, "same TIE"), (101, "nowhere"), (102, ""), (103, None), (None, "tie tie w1"), (104, "É straße x"), (104, "w2 w3"), (105, "w4"), (105, "w4"), (106, "w1 w1 w2"), (107, "longword" * 5000)]
    got = [tuple(r) for r in term_search.search(docs(spark, rows).repartition(5), items(spark, wanted)).collect()]
    assert order(got) == order(brute_search(rows, wanted))
    assert len({(i, r) for i, r, *_ in got if i not in (104,)}) == len([1 for i, *_ in got if i not in (104,)])


def test_search_of_nothing(spark):
    some = docs(spark, [(1, "a b")])
    assert term_search.search(some.where("false"), items(spark, [(1, "a")])).collect() == []
    assert term_search.search(some, items(spark, [(1, "a")]).where("false")).collect() == []
    assert term_search.search(docs(spark, [(1, None), (None, "")]), items(spark, [(1, "a")])).collect() == []


def test_search_where_every_document_holds_the_term(spark):
    """A third of all rows and more in one list: its weight is small, yet above 0."""
    rows = [(k, f"the hot term {k % 7}") for k in range(600)]
    wanted = [(1, "hot"), (2, "the 3")]
    assert order(tuple(r) for r in term_search.search(docs(spark, rows).repartition(7), items(spark, wanted)).collect()) == order(brute_search(rows, wanted))


TEXTS = [
    None, "", " ", " a  b ", "don't\n\n x's 'RE we'll", "½ ²3 é\xa0\xa0b\x85c \x1c d", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "日本 x", "ªº_ __a--b", "İstanbul ΣΑΣ", "éa", "👍🏽 ok", "ﬁ ﬀ Ǆ",
    "a" * 5000, "abab" * 3000, "x1y2" * 500, "Same text", "Same text", "­​ zero",
]


def library(text):
    t = boundary_bpe.boundary_bpe().library
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark):
    rng = random.Random(2)
    pools = [range(32, 127), range(boundary_bpe.LATIN), range(0x2000), range(0x1F300, 0x1F700)]
    texts = TEXTS + [chr(c) * 2 + "a" + chr(c) for c in range(boundary_bpe.LATIN)] + ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(60))) for _ in range(1500)]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    got = boundary_bpe.encoded(docs(spark, rows).repartition(3)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter((i, tuple(library(t)[0]), library(t)[1]) for i, t in rows)


def test_bpe_of_whole_documents_and_the_query(spark):
    from paceline.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_boundary_bpe(spark, "/root/testdata/sf0.001").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {i: (len(ids), sha(" ".join(map(str, ids))), sha(text)) for i, (ids, text) in ((r["doc_id"], library(r["text"])) for r in rows)}


def test_boundaries_are_reached_by_no_token():
    bpe = boundary_bpe.boundary_bpe()
    assert 0.5 < bpe.forced.mean() < 1
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.randrange(33, 256) for _ in range(rng.randrange(2, 200)))
        cuts = bpe.cuts(word)
        assert cuts == [k for k in range(1, len(word)) if bpe.forced[word[k - 1], word[k]]]
        assert bpe.word_ids(word) == bpe._merged(word, True)
    assert boundary_bpe.encoded is not None and list(bpe.encode("")) == []


def test_short_and_long_fragments_merge_alike(monkeypatch):
    bpe = boundary_bpe.boundary_bpe()
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 24))).encode() for _ in range(500)]
    short = [bpe._merged(w, last) for w in words for last in (True, False)]
    monkeypatch.setattr(boundary_bpe, "SHORT", 0)
    assert short == [bpe._merged(w, last) for w in words for last in (True, False)]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * np.float64(x)) if abs(x) < 1 << 53 else 4096 * int(x) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    errors = [min(sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)), (1 << 63) - 1) for (_, v, _), c in zip(kept, codes)]
    by = Counter()
    for (_, _, label), e in zip(kept, errors):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in c), err, min(by[label], (1 << 63) - 1), digest) for (i, _, label), c, err in zip(kept, codes, errors)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, error int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), label, "x", 1) for i, v, label in rows], VECTORS)


def check_codes(spark, good, bad=()):
    got = vector_codes.vector_codes(vectors(spark, [*good, *bad]).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert order(tuple(r) for r in got.collect()) == order(brute_codes(good))


def test_codes(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 32))
    good = [(3 * k, base[k % 12] + 0.3 * rng.standard_normal(32), k % 3 or None) for k in range(300)]
    good += [(2000 + k, base[0], 9) for k in range(200)] + [(5, base[1], 1), (5, base[2], 1), (None, base[3], None), (2500, np.zeros(32), 2), (2501, -base[4] * 40, 2)]
    bad = [(1, None, 1), (2, [], 1), (4, [1.0] * 31 + [None], 1), (7, [1.0] * 31 + [float("nan")], 1), (8, [1.0] * 31 + [float("-inf")], 1), (10, [1.0] * 24, 1), (11, [1.0] * 30, 1)]
    check_codes(spark, good, bad)


def test_codes_of_ties_few_rows_and_any_size(spark):
    rng = np.random.default_rng(1)
    check_codes(spark, [(k, rng.integers(-1, 2, 16) / 4096, k % 2) for k in range(120)])
    check_codes(spark, [(k, rng.standard_normal(8), 1) for k in range(5)])
    check_codes(spark, [(k, rng.standard_normal(16) * 10.0 ** rng.integers(-3, 60), k % 4) for k in range(60)])
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)]).where("false")).collect() == []


def test_bounds_filter_and_never_lose_the_nearest():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 8, 13, 32):
        x, c = rng.integers(-9000, 9000, (400, width)), rng.integers(-9000, 9000, (16, width))
        x[:100] = c[rng.integers(0, 16, 100)] + rng.integers(-1, 2, (100, width))
        best, far = vector_codes.nearest(x, c)
        want = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (best == want.argmin(1)).all() and (far == want.min(1)).all()
