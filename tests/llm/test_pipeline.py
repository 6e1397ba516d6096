"""The pipeline's stages on planted documents, and its run."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from paceline.llm import stages


def planted(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(25)) for _ in range(n))
    line = " ".join(word() for _ in range(30))
    rows, marks = [], []
    for i in range(400):
        t = text(3)
        toxic = int(i % 8 == 0)
        if toxic:
            t = t.replace("a", "vermin ", 3) + " vermin wretched vermin wretched"
        marks.append((i, 1, toxic))
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    clean = [r for r in rows if r[0] % 8]
    rows += [(1000 + k, r[1].replace(" ", " x ", 1), "en", "s1", 1) for k, r in enumerate(clean[:20])]  # near copies
    reflowed = lambda t: "\n".join(" ".join(t.split()[k : k + 14]) for k in range(0, len(t.split()), 14))
    rows += [(4000 + k, reflowed(r[1]), "en", "s1", 1) for k, r in enumerate(clean[30:50])]  # copies with other line ends
    rows += [(2000 + k, text(2) + "\n" + line, "en", "s2", 1) for k in range(20)]
    rows += [(5000, text(1), "en", "s0", 9)] * 3 + [(None, text(1), "en", "s1", 9) for _ in range(4)]
    rows += [(5001, "\n".join(text(40) for _ in range(20)), "en", "s0", 9)]  # a long one
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (None, "row without a name", "en", "s0", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), line


def test_stages(spark, tmp_path):
    docs, labels, line = planted(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    kept = stages.toxicity(spark, docs, sf)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and {3000, 3001, None} <= ids
    assert sum(i in ids for i in range(0, 400, 8)) <= 5 and sum(i in ids for i in range(400) if i % 8) >= 345
    lines = stages.line_dedup(spark, docs, sf)
    got = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == docs.columns and set(got) == {r["doc_id"] for r in docs.collect()} - set(range(1000, 1020))
    assert [i for i in range(2000, 2020) if line in got[i]["text"].split("\n")] == [2000]
    assert {got[i]["text"] for i in range(4000, 4020)} == {r["text"] for r in docs.where("doc_id between 4000 and 4019").collect()}
    near = {r["doc_id"] for r in stages.minhash_dedup(spark, lines, sf).collect()}  # of what line dedup has left
    assert not near & set(range(4000, 4020)) and set(range(400)) <= near and {3000, 3001, 5001, None} <= near
    near = {r["doc_id"] for r in stages.minhash_dedup(spark, docs, sf).collect()}
    assert not near & {*range(1000, 1020), *range(4000, 4020)} and set(range(400)) <= near and {3000, 3001, 5001, None} <= near
    mixed = stages.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert corpus_pipeline.run(spark, sf).count() > 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_stages_with_clashing_names(spark, tmp_path):
    docs, labels, _ = planted(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    own = "__id __gone __words __at row start size target kept keep_id score n_shingles component_id doc tie at".split()
    wide = docs
    for k, c in enumerate(own):
        wide = wide.withColumn(c, F.lit(k))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert out.count() > 0 and (name == "packing" or out.columns == wide.columns), name
