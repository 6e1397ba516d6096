"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.url_filters import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.token_output import packed_rows

    return packed_rows(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op11_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.term_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.boundary_bpe import encoded

    out = encoded(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_embedding_dedup, op3_mixing, op4_minhash, op5_substring_dedup, op6_url_filters, op7_toxicity, op8_line_dedup, op9_token_output, op10_packing, op11_term_search, op12_boundary_bpe, op13_vector_codes)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another: assign by least distance and index, then floors of means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM
            (SELECT v.*, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{k} USING (p)) GROUP BY vec_id, label, p)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT len(any_value(x)) FROM v) + 1)) AS j) GROUP BY p, e, j),
            m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{k} GROUP BY p, e),
            c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)::BIGINT) AS y FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        v AS MATERIALIZED (SELECT vec_id, label, p, y[p * (len(y) // {parts}) + 1:(p + 1) * (len(y) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
        c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v QUALIFY e < {entries}),
        {", ".join(steps)},
        r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


ORACLES = {
    "op11_term_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        s AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d),
        p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY doc_id, n, t),
        w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
        q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
        r AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
              FROM q JOIN w USING (t) JOIN p USING (t), s GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20""",
    "op13_vector_codes": _codes_sql(),
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM s),
        g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM k WHERE r > 1 GROUP BY doc_id),
        e AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
        p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)) AS kept FROM e)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(list_transform(kept, lambda x: w[x]), ' '), '')) AS kept_sha256 FROM p""",
    "op1_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256({_LOW}) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY {_LOW})""",
    "op3_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5(doc_id::VARCHAR) AS turn FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
        f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
        k AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
                  - ((sum(2 * source_size) OVER (ORDER BY full_at, source NULLS LAST))::BIGINT - 2 * source_size))
                / (sum(weight) OVER (ORDER BY full_at DESC, source DESC NULLS FIRST))::BIGINT AS level_k FROM f),
        t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level_k) OVER () * weight) AS target FROM k),
        p AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size
                  ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start FROM d),
        u AS (SELECT p.*, source_size, target, pass, unnest(range(0, size, 256)) AS begun
              FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS pass)),
        v AS (SELECT *, least(256, size - begun) AS words, (start + pass * source_size + begun + least(256, size - begun)) / target AS finish FROM u),
        q AS (SELECT *, (sum(words) OVER (ORDER BY finish, source NULLS FIRST, start, pass, begun ROWS UNBOUNDED PRECEDING))::BIGINT - words AS before FROM v),
        g AS (SELECT source, start, sum(least(words, greatest((SELECT floor(1.5 * sum(size))::BIGINT FROM d) - before, 0)))::BIGINT AS taken FROM q GROUP BY source, start)
        SELECT p.doc_id, p.size::BIGINT AS size, t.source_size, t.target, CASE WHEN p.size > 0 THEN coalesce(g.taken, 0) ELSE 0 END::BIGINT AS taken
        FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
        LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.start = g.start""",
}
