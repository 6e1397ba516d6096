"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import common, embedding_dedup, exact_dedup, line_dedup, minhash, mixing, packing, substring_dedup, token_output, toxicity, url_filters
from paceline.llm.tokens import encoder

DOCS = "doc_id long, text string, source string, kept string, keep_id int, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = " ".join(words(rng, 40_000))
    base = words(rng, 120)
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 60, 110)]
    passage = " ".join(words(rng, 70))
    return [
        (1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, "Same text here", "b"), (5, "same TEXT here", "b"), (6, "same text here", None), (7, long, "a"), (8, "É stays É", "c"), (9, "é stays é", "c"),
        *[(20 + k, t, "a") for k, t in enumerate(near)], (30, "one two " + passage + " three", "b"), (31, passage + " four", "b"), (32, "x y " * 60, "b"), (33, "word", "c"), (33, "word", "c"), (None, "lost row", "c"), (None, None, "c"),
    ]


def test_exact(spark, odd):
    got = exact_dedup.exact_dedup(docs(spark, odd)).collect()
    assert len(got) == len(odd)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t, _ in odd:
        groups.setdefault(low(t), []).append(i)
    want = sorted((i is not None, i or 0, max([x for x in groups[low(t)] if x is not None], default=-1), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t, _ in odd)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want


def test_exact_hot_group(spark):
    rows = [(k, "the Same hot text" if k % 3 else f"text {k % 60}", "s") for k in range(3000)] + [(7, "the same hot text", "s"), (None, "the same hot text", "s")]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(9)).collect()
    groups = Counter(t.lower() for _, t, _ in rows)
    keep = {}
    for i, t, _ in rows:
        keep[t.lower()] = max(keep.get(t.lower(), -1), -1 if i is None else i)
    names = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows) and Counter(r["text_sha256"] for r in got) == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in groups.items()}
    assert all((r["keep_id"], r["group_size"]) == (keep[names[r["text_sha256"]]], groups[names[r["text_sha256"]]]) and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_collision(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_fingerprint", colliding())
    rows = [(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, "b", "s"), (5, "c", "s")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def colliding():
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [(x or "").encode() for x in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array([b"same"] * len(texts), pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            names = ["doc_id", "content_key", "text_sha256"]
            if "body" in b.schema.names:
                cols, names = [*cols, b.column("body")], [*names, "body"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def brute_components(sets):
    ids = list(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def check_near(spark, rows):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    want = brute_components(sets)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in want} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    return got


def test_minhash_odd(spark, odd):
    got = check_near(spark, odd)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_minhash_groups(spark):
    """Near copies at many distances from one text, chains, a shared passage: no link and no component is lost."""
    rng = random.Random(1)
    rows, i = [], 0
    for group in range(6):
        base = words(rng, rng.choice([20, 60, 150, 400]))
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 10, 14])):
                w[rng.randrange(len(w))] = f"m{rng.randrange(40)}"
            rows.append((i := i + 1, " ".join(w), "s"))
    w = words(rng, 80)
    for k in range(30):  # a chain: each next to the one before
        w = list(w)
        w[(7 * k) % 80] = f"c{k}"
        rows.append((i := i + 1, " ".join(w), "s"))
    passage = words(rng, 60)
    for _ in range(80):
        rows.append((i := i + 1, " ".join(words(rng, 20) + passage + words(rng, 20)), "s"))
    check_near(spark, rows)


def test_minhash_blocks(spark, monkeypatch):
    rng = random.Random(2)
    base = words(rng, 100)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 2, 3, 5, 7])):
            w[rng.randrange(100)] = f"m{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "s"))
    monkeypatch.setattr(minhash, "BLOCK", 64)
    check_near(spark, rows)


def brute_repeats(rows, n=20):
    first, texts = {}, {}
    order = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t, _ in order:
        w = (t or "").encode().split()
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (i, s))
    for i, t, _ in order:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (i, s):
                gone |= set(range(s, s + n))
        texts.setdefault(i, (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return texts


def test_substring(spark, odd):
    rng = random.Random(3)
    passage = words(rng, 60)
    rows = [r for r in odd if r[0] is not None] + [(100 + k, " ".join(words(rng, 30) + passage[k % 20 :] + words(rng, 10) + passage[: 25 + k % 9]), "s") for k in range(60)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs(spark, rows).repartition(5)).collect()}
    assert got == brute_repeats(rows)


def test_mixing(spark, odd):
    rng = random.Random(4)
    rows = odd + [(1000 + k, " ".join(words(rng, rng.randrange(60))), f"s{min(k % 9, 4)}") for k in range(400)]
    got = mixing.mix(docs(spark, rows), rows_per_bucket=16).collect()
    again = mixing.mix(docs(spark, rows).repartition(7), rows_per_bucket=16).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["target"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.discard(s)
    source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sorted(x[1] for x in source) == pytest.approx(sorted(target.values()))
    total = sum(sizes.values())
    assert sum(r["taken"] for r in got) == total * 3 // 2
    for (_, t), taken in source.items():
        assert abs(sum(taken) - t) <= mixing.QUANTUM


def test_mixing_against_a_queue_by_hand(spark, monkeypatch):
    monkeypatch.setattr(mixing, "QUANTUM", 16)
    rng = random.Random(6)
    rows = [(k, " ".join(words(rng, rng.choice((0, 1, 15, 16, 17, 40, 300)))), rng.choice("aaaaabbc")) for k in range(300)]
    got = {r["doc_id"]: r for r in mixing.mix(docs(spark, rows), rows_per_bucket=16).collect()}
    events = []
    for s in "abc":
        at = 0
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if x == s)
        for e in (0, 1):
            for _, i, n in own:
                for k in range(0, n, 16):
                    w = min(16, n - k)
                    events.append(((at + k + w) / got[i]["target"], s, at, i, w))
                at += n
    left, taken = int(1.5 * sum(len(t.split()) for _, t, _ in rows)), dict.fromkeys(got, 0)
    for _, _, _, i, w in sorted(events):
        taken[i] += min(w, left)
        left -= min(w, left)
    assert {i: r["taken"] for i, r in got.items()} == taken


def test_mixed_documents_keep_their_rows(spark, odd):
    rng = random.Random(4)
    rows = odd + [(7000, "five rows of one name", "b")] * 5 + [(None, f"nameless {k} row", "a") for k in range(10)] + [(1000 + k, " ".join(words(rng, rng.randrange(60))), f"s{min(k % 9, 4)}") for k in range(400)]
    table = docs(spark, rows).withColumn("__id", F.lit(1)).withColumn("row", F.lit("r")).withColumn("start", F.lit(2))
    out = mixing.mixed_documents(table, rows_per_bucket=16)
    assert out.columns == table.columns
    have, made = Counter((i, t, s) for i, t, s in rows), Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert all(made[k] <= 2 * have[k] for k in made) and all(made[k] == have[k] for k in have if not (k[1] or "").split())
    want = {r["doc_id"]: r for r in mixing.mix(docs(spark, rows), rows_per_bucket=16).collect()}
    whole = [i for i, r in want.items() if i is not None and i not in (33, 7000) and r["size"] and r["taken"] in (0, r["size"], 2 * r["size"])]
    got = Counter(i for i, _, _ in made.elements())
    assert len(whole) > 300 and all(got[i] == want[i]["taken"] // want[i]["size"] for i in whole)


def test_packing(spark, odd):
    rows = docs(spark, odd)
    got = packing.pack_documents(rows).collect()
    enc = encoder()
    by = {}
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048
    texts = {i: t for i, t, _ in odd if i not in (None, 33)}
    for i, t in texts.items():
        mine = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == i)
        assert b"".join(x for _, x in mine) == enc.ids(t or "") + (1).to_bytes(4, "little")
    assert sum(r["length"] for r in got if r["doc_id"] == 33) == 2 * (len(enc.ids("word")) // 4 + 1)


def test_tokens_equal_the_library():
    enc = encoder()
    for t in ["", " a  b ", "don't\n\n x", "½ ²3 é\xa0\xa0b\x85c \x1c d", "a<|endoftext|>b", "日本 x", "ªº_ __a--b", "it's 'RE"]:
        assert np.frombuffer(enc.ids(t), np.uint32).tolist() == enc.library.encode(t, add_special_tokens=False).ids


def test_token_rows_round_trip(spark, odd):
    rows = token_output.packed_rows(docs(spark, odd).coalesce(1)).collect()
    found = {}
    for r in rows:
        ids, pos = np.frombuffer(r["input_ids"], np.uint32), np.frombuffer(r["position_ids"], np.uint32)
        assert len(ids) == 2048 and r["cu_seqlens"][-1] == r["n_tokens"] == len(pos)
        for k, (a, z) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
            assert pos[a:z].tolist() == list(range(z - a))
            found.setdefault(r["doc_ids"][k], []).append((r["starts"][k], ids[a:z].tobytes()))
    for i, t, _ in odd:
        if i not in (None, 33):
            assert b"".join(x for _, x in sorted(found[i])) == encoder().ids(t or "") + (1).to_bytes(4, "little")


def test_token_query_gives_the_whole_output(spark, odd, tmp_path):
    from paceline.llm import queries

    docs(spark, odd).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op9_token_output(spark, str(tmp_path)).collect()
    assert rows
    for r in rows:
        resets = [k for a, z in zip(r["cu_seqlens"], r["cu_seqlens"][1:]) for k in range(z - a)]
        assert len(r["input_ids"]) == 4 * 2048 and zlib.crc32(r["input_ids"]) == r["ids_crc32"]
        assert np.frombuffer(r["position_ids"], np.uint32).tolist() == resets
    token_output.write_packed(docs(spark, odd).coalesce(1), str(tmp_path / "packed"))
    key = lambda r: (r["pool"], r["row"], bytes(r["input_ids"]), bytes(r["position_ids"]))
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "packed")).collect())) == sorted(map(key, rows))


def test_best_fit():
    rng = random.Random(0)
    lengths = [rng.randint(1, 50) for _ in range(400)]
    bins = token_output.best_fit_decreasing(lengths, 50)
    left, want = [], []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fits = [b for b in range(len(left)) if left[b] >= lengths[i]]
        b = min(fits, key=lambda b: left[b]) if fits else len(left)
        if not fits:
            left.append(50)
            want.append([])
        left[b] -= lengths[i]
        want[b].append(i)
    assert len(bins) == len(want) and sorted(i for b in bins for i in b) == list(range(400))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = [(k, (base[k % 60] + 0.08 * rng.standard_normal(16)).tolist(), 1) for k in range(400)]
    rows += [(500 + k, base[0].tolist(), 1) for k in range(50)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, [1.0, 2.0], 1), (None, base[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and (i < 600)]
    x = np.stack([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    assert {i: got[i][0] for i, _ in good} == {i: int(near[k].sum() - 1) for k, (i, _) in enumerate(good)}
    label = list(range(len(good)))
    for _ in range(20):
        label = [min(label[j] for j in np.flatnonzero(near[k])) for k in range(len(good))]
    assert {i: got[i][1] for i, _ in good} == {i: good[label[k]][0] for k, (i, _) in enumerate(good)}
    assert all(got[i] == (0, i) for i in range(600, 605)) and got[None] == (0, None)


def test_vectors_beyond_the_sample(spark, monkeypatch):
    """Trees that go deeper than their sample, and vectors whose squares over- or underflow: every planted link is found."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 200)
    monkeypatch.setattr(embedding_dedup, "NODE", 16)
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 24))
    near = base[:500] + 0.2 * rng.standard_normal((500, 24))
    rows = [(i, v) for i, v in enumerate([*base, *near])] + [(9000, base[0] * 1e-200), (9001, base[1] * 1e200), (9002, base[2] * 1e-310)]
    own = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(own).collect()}
    x = np.array([v / np.abs(v).max() for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip([i for i, _ in rows], ((x @ x.T >= 0.95).sum(1) - 1).tolist()))
    assert sum(want.values()) > 800 and all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * sum(want.values())
    assert all(got[i] == want[i] for i in (9000, 9001))


def test_lines(spark):
    para = "The quick brown foxes jumped over many lazy dogs while the sun was setting behind old hills and the people of the town went home to sleep until morning"
    rows = [
        (1, f"unique start of one\n{para}\nend one", "s"), (2, f"{para}\nother words altogether in here", "s"), (3, para.replace("old", "odd") + "\n\n\n- \n- ", "s"), (4, None, "s"), (5, "", "s"), (None, para, "s"),
        (6, "日本語の長い行は空白がないので文字ごとに比べられますこの行は長い\nx", "s"), (7, "日本語の長い行は空白がないので文字ごとに比べられますこの行は長いよ", "s"), (8, "\t\n\t\nend one", "s"),
    ]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1]
    assert got[2]["text"] == "other words altogether in here" and got[2]["__n_removed"] == 1
    assert got[3]["text"] == "\n\n- "
    assert got[4]["text"] is None and got[5]["text"] == "" and got[None]["text"] == para
    assert got[7]["text"] == "" and got[8]["text"] == "\t\n\t"
    assert got[1]["keep_id"] == 1


def line_set(line, n=10):
    units = line.encode("utf-16-be")
    return {units[i : i + 2 * n] for i in range(0, max(len(units) - 2 * n, 0) + 1, 2)}


def test_line_shingles_cover_every_character(spark):
    rng = random.Random(1)
    lines = ["", "short", "tencharact", "x" * 300, "xyxy " * 40 + "tail of another kind " + " ".join(words(rng, 20)), "https://example.org/a/1", "日本語の長い行は空白がない😀あ", *["".join(rng.choice("ab é語😀") for _ in range(n)) for n in (11, 64, 72, 73, 74, 137, 138, 700)]]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    sets = line_dedup.sketched(df.withColumn("s", line_dedup.shingles(F.col("line"))), "k", "s").collect()
    for r in sets:
        own = line_set(lines[r["k"]])
        assert len(set(r["s"])) == len(own) and len(r["s"]) == max(len(lines[r["k"]].encode("utf-16-be")) // 2 - 9, 1)
        assert r["low"] == sorted(set(r["s"]))[: line_dedup.SKETCH]


def test_crowded_hub_is_compared_whole(spark, monkeypatch):
    """120 lines of one head that share no triple of their sketches: each has one link, in its hub only."""
    monkeypatch.setattr(line_dedup, "_triples", lambda low: F.array(F.xxhash64(low)))
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(3)
    head = "".join(rng.choice("abcdefghij") for _ in range(150))
    letters = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
    lines = [head + letters(30) for _ in range(60)]  # pairs at some 0.66: the same hub, no link
    lines += [x[:-3] + "xyz" for x in lines]  # one link each
    sets = [{x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)} for x in lines]
    near = {j for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= line_dedup.PERCENT * len(sets[i] | sets[j])}
    assert near == set(range(60, 120))
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, "s") for i, x in enumerate(lines)]).repartition(4)).where("__n_removed > 0").collect()}
    assert got == near


def test_template_lines_lose_no_link(spark, n=1500):
    """Lines of one head whose links rest on the head alone: crowded everywhere, above the threshold for the shorter tails only."""
    rng = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyz"
    head = "".join(rng.choice(letters) for _ in range(180))
    lines = [head + "".join(rng.choice(letters) for _ in range(19 if k % 3 else 25)) for k in range(n)] + [head + "".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    sets = [line_set(x) for x in lines]
    root = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    want = {i for i, r in enumerate(root) if r != i}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, "s") for i, x in enumerate(lines)]).repartition(4)).where("__n_removed > 0").collect()}
    assert len(want) > n / 2 and got == want


def test_groups_of_lines_against_brute_force():
    """What groups of lines join is what every link of brute force joins, however batches cut the groups."""
    import pyarrow as pa

    def joined(pairs):
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return {x: top(x) for x in root}

    rng, links = random.Random(3), 0
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(25):
        rows = []
        for k in range(rng.randrange(1, 20)):
            head, comps = line(150), rng.choice([1, 2, 3, 6])
            rows += [(k, bytes([k, rng.randrange(comps)]), head + line(rng.choice([2, 10, 18, 25, 40]))) for _ in range(rng.choice([1, 2, 3, 8, 15]))]
        table = pa.table({"group": pa.array([r[0] for r in rows], pa.int64()), "comp": pa.array([r[1] for r in rows], pa.binary()), "line": [r[2] for r in rows]})
        found = [(p["a"], p["b"]) for batch in line_dedup._joins_of_groups(iter(table.to_batches(max_chunksize=rng.choice([1, 7, 1000])))) for p in batch.to_pylist()]
        sets = [line_set(r[2]) for r in rows]
        want = [(rows[i][1], rows[j][1]) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and rows[i][1] != rows[j][1] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert joined(found) == joined(want)
        links += len(want)
    assert links > 500


def test_lines_of_far_apart_names(spark):
    """Names that a packed 64-bit place couldn't hold, and a recall of one on planted groups by brute force."""
    rng = random.Random(8)
    lines = [" ".join(words(rng, rng.randrange(6, 60))) for _ in range(60)]
    for x in list(lines):
        for _ in range(rng.randrange(8)):
            w = x.split()
            w[rng.randrange(len(w))] = f"m{rng.randrange(1000)}"
            lines.append(" ".join(w))
    names = sorted(rng.sample([*range(100), *range(1 << 40, (1 << 40) + 100), *range((1 << 62), (1 << 62) + 100), *range(-100, 0)], 320)[: len(lines)])
    lines = lines[: len(names)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [(i, x, "s") for i, x in zip(names, lines)])).collect()}
    want = line_groups(lines)
    assert len(set(want)) < len(lines) - 50
    assert {i for i, x in got.items() if x} == {names[k] for k in range(len(lines)) if want[k] == k}


def test_repeated_rows_and_very_long_lines(spark):
    rng = random.Random(9)
    long = " ".join(words(rng, 20_000))
    rows = [(1, long, "s"), (2, long.replace("w7 ", "w8 ") + "\nmine", "s"), (3, "one line of text\ntwo", "s"), (3, "one line of text\ntwo", "s"), (3, "another line there\nthree", "s"), (4, "two\n" * 3000 + "end", "s"), (5, "another line there", "s")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert got == sorted([(1, long), (2, "mine"), (3, "one line of text\ntwo"), (3, "one line of text\ntwo"), (3, "another line there\nthree"), (4, "end"), (5, "")])


def test_lines_that_share_only_beginnings_stay(spark):
    lines = ["https://ex.org/a/1111", "https://ex.org/b/2222", "2024-01-01T10:00:00", "2024-01-01T11:22:33", "日本語の長い行は空白がないので", "日本語の長い行は空白があるから"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [(k, x, "s") for k, x in enumerate(lines)])).collect()}
    assert got == dict(enumerate(lines))


def line_groups(lines):
    """First line of the component of each, by brute force over all pairs."""
    sets, first = [line_set(x) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if first[i] != first[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((first[i], first[j]))
                first = [lo if x == hi else x for x in first]
    return first


def test_hot_template_lines_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    head = " ".join(words(rng, 14))
    tails = [" ".join(words(rng, 34)) for _ in range(6)]
    lines = [f"{head} {' '.join(words(rng, 34))}"]
    for _ in range(150):
        w = f"{head} {rng.choice(tails)}".split()
        w[rng.randrange(20, len(w))] = f"m{rng.randrange(1000)}"
        lines.append(" ".join(w))
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    # all lines have one band value, so that one line is the hub of all of them
    monkeypatch.setattr(line_dedup, "bands", lambda low: F.array(F.lit(7).cast("long")))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [(k, x, "s") for k, x in enumerate(lines)])).collect()}
    want = line_groups(lines)
    assert len(set(want)) == 7
    assert {k for k, x in got.items() if x} == {k for k in got if want[k] == k}
    monkeypatch.undo()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [(k, x, "s") for k, x in enumerate(lines)])).collect()}
    assert {k for k, x in got.items() if x} == {k for k in got if want[k] == k}


def test_urls(spark):
    urls = ["http://A.example.org/es/1", "https://example.org/en/12?x=1", "http://x.com/fr/", "http://x.com/de/9#a", "http://x.net/q?b=2", "nothing", None, "http://y.org", "x://h?://z/en/1"]
    good = [(k, f"http://good.net/page/{k}") for k in range(100, 360)] + [(k, f"http://bad.net/spam/{k}?ad=1") for k in range(360, 500)]
    good += [(None, "http://bad.net/spam/1?ad=1"), (7000, "http://bad.net/spam/2?ad=1"), (7000, "http://bad.net/spam/2?ad=1"), (7001, "http://bad.net/spam/" + "x/" * 30_000 + "?ad=1")]
    pages = spark.createDataFrame([*enumerate(urls), *good], "page_id long, url string").withColumn("rule", F.lit(1))
    labels = spark.createDataFrame([(k, 1, int(k >= 360)) for k in range(100, 490)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, labels).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/9", "com/de/", "block"),
        ("x.net", "/q", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("y.org", "", None, "allow"), ("h", "", None, "allow"),
    ]
    assert all(got[k]["verdict"] == ("block" if k >= 360 else "allow") for k in range(100, 500))
    assert got[None]["verdict"] == got[7000]["verdict"] == got[7001]["verdict"] == "block"


def test_url_labels_without_meaning_make_no_rule(spark):
    rng = random.Random(3)
    pages = [(k, f"http://h{rng.randrange(9)}.net/p{rng.randrange(9)}/q{rng.randrange(9)}") for k in range(1500)]
    labels = [(k, int(rng.random() > 0.3), 0) for k in range(1500)]
    got = url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 1500 and sum(r["verdict"] == "block" for r in got) <= 15


def test_url_tokens_that_always_come_together(spark):
    """Forty names that all bad pages share, and forty that good and bad ones share: no itemsets of them all, and the same pages blocked."""
    import time

    many = lambda p: "&".join(f"{p}{k}=1" for k in range(40))
    pages = [(k, f"http://s{k % 7}.net/a?{many('bad')}" if k % 4 == 0 else f"http://s{k % 7}.net/a?{many('any')}" if k % 4 == 1 else f"http://s{k % 7}.net/b") for k in range(520)]
    labels = [(k, 1, int(k % 4 == 0 or k % 4 == 1 and k % 8 == 1)) for k in range(520)]
    began = time.time()
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert time.time() - began < 120
    assert all(got[k] == "block" for k in range(0, 520, 4)) and all(got[k] == "allow" for k in range(520) if k % 4 > 1)


def test_url_matching_against_brute_force(spark):
    rng = random.Random(2)
    kinds = [(sorted({f"t{rng.randrange(9)}" for _ in range(4)}), rng.randrange(1, 9)) for _ in range(80)]
    rules = [tuple(sorted({f"t{rng.randrange(9)}" for _ in range(n)})) for n in (1, 2, 2, 3, 3, 3)]
    got = url_filters.matched(spark.createDataFrame(kinds, "tokens array<string>, n long"), spark.createDataFrame([(list(r),) for r in rules], "antecedent array<string>")).collect()
    want = Counter((tuple(k), n, r) for k, n in kinds for r in rules if set(r) <= set(k))
    assert Counter((tuple(r["tokens"]), r["n"], tuple(r["antecedent"])) for r in got) == want


def test_url_rules_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(sorted({f"t{rng.randrange(6)}" for _ in range(3)}), rng.random() < 0.4) for _ in range(120)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {tuple(r["antecedent"]) for r in url_filters.mined_rules(df, 0.05, 0.5).collect()}
    from itertools import combinations

    names = sorted({t for ts, _ in rows for t in ts})
    rules = set()
    for n in (1, 2, 3):
        for c in combinations(names, n):
            hits = [b for ts, b in rows if set(c) <= set(ts)]
            if hits and sum(hits) >= 0.05 * len(rows) and sum(hits) / len(hits) >= 0.5:
                rules.add(c)
    assert got == {c for c in rules if not any(tuple(x for x in c if x != t) in rules for t in c)}


def test_toxicity_tells_classes_of_equal_words_apart_by_phrases(spark):
    """Toxic texts are of sixty phrases, others of the same words in another order: no word tells them apart."""
    rng = random.Random(1)
    phrases = [words(rng, 4, 400) for _ in range(60)]
    rows, marks = [], []
    for i in range(900):
        body = [w for _ in range(rng.choice((6, 12, 40, 200))) for w in rng.choice(phrases)]
        if i % 3:
            rng.shuffle(body)
        rows.append((i, " ".join(body), "a"))
        marks.append((i, 1, int(i % 3 == 0)))
    long = " ".join(w for _ in range(9000) for w in rng.choice(phrases))
    rows += [(5000, long, "a"), (5001, long, "a"), (3, rows[3][1], "b")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900 and r["doc_id"] != 3]
    yes, no = ([r["score"] for r in held if (r["doc_id"] % 3 == 0) is toxic] for toxic in (True, False))
    assert sum(a > b for a in yes for b in no) >= 0.98 * len(yes) * len(no)
    assert len(got) == len(rows)
    assert [r["predicted"] for r in got if r["doc_id"] >= 5000] == [1, 1] and len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_toxicity(spark):
    rng = random.Random(0)
    bad = ["horrible", "vermin", "wretched"]
    rows, marks = [], []
    for i in range(900):
        w, toxic = words(rng, 60, 400), int(i % 4 == 0)
        for _ in range(4 * toxic):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, toxic))
    rows += [(2000, None, "s"), (2001, "", "s"), (None, "vermin vermin vermin", "s")]
    labels = spark.createDataFrame(marks + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.9
    assert got[2000]["score"] == got[2001]["score"] < 0.5
    flat = toxicity.toxicity(docs(spark, rows[:5]), labels.limit(0)).collect()
    assert {r["score"] for r in flat} == {0.5}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    assert got == {x: root(x) for x in parent if x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_empty(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (exact_dedup.exact_dedup(none), minhash.near_duplicates(none), substring_dedup.remove_repeats(none), mixing.mix(none), mixing.mixed_documents(none), packing.pack_documents(none), token_output.packed_rows(none), line_dedup.dedup_lines(none), toxicity.toxicity(none, labels), embedding_dedup.near_vectors(vectors)):
        assert df.count() == 0
    assert url_filters.filter_urls(pages, labels).count() == 0
