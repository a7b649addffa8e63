"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, branch_topk, covering_simhash, html_tree, mixing, multi_index, rans, subsequence_svm, token_count, tree_bpe, vector_codes, zorder_layout, zstd_quality
from .common import fold, table, work_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: A text of at least this score is of good quality.
GOOD = 0.7
#: Domains of the labelled table, by quality and toxicity, and the weights they shall have.
DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
TARGETS = {"q0t0": 0.04, "q0t1": 0.01, "q1t0": 0.90, "q1t1": 0.05}


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rans.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), out, end=0)
    return rans.read_tokens(spark, out)


def op2_branch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64.0)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 1024)


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bloom_lm.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return rows.withColumn("held_out", ~F.col("train")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> zstd_quality.Model:
    """Learned from labels outside the held-out fold."""
    return zstd_quality.fit(docs, labels.filter(fold("doc_id", 4) != 2))


def op5_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = zstd_quality.score(docs.select("doc_id", "text"), quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op6_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def domain_of_labels() -> Column:
    """Domain of a row of the labelled table."""
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = mixing.fit(docs, table(spark, sf_dir, "labels"), domain_of_labels())
    mixed, _ = mixing.mix(docs.select("doc_id", "text"), classifier, TARGETS, keep_text=False)
    p = {d: F.col("posterior")[i] for i, d in enumerate(classifier.domains)}
    return mixed.select("doc_id", "tokens", *[p.get(d, F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS], "rate")


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))


def op12_zorder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zorder_layout.layout(table(spark, sf_dir, "documents"))


def op13_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = subsequence_svm.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    scored = subsequence_svm.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_rans_tokens, op2_branch_topk, op3_token_count, op4_bloom_lm, op5_zstd_quality, op6_html_tree, op7_multi_index, op8_tree_bpe, op9_soft_mixing, op10_covering_simhash, op11_vector_codes, op12_zorder_layout, op13_subsequence_svm)
    return {f.__name__: f for f in own}


def _codes_sql() -> str:
    """Two rounds of the codebooks and the codes, each round a pair of subqueries."""
    book = """
            b0 AS MATERIALIZED (
                SELECT part, n - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p) WHERE n <= 64
            )"""
    near = """
            a{i} AS MATERIALIZED (
                SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
                    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                    FROM p JOIN b{i} b ON p.part = b.part
                ) GROUP BY ALL
            )"""
    move = """
            b{j} AS MATERIALIZED (
                SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
                    SELECT part, entry, list(v ORDER BY pos) AS x FROM (
                        SELECT a.part, a.best.entry AS entry, pos, CAST(floor(sum(p.x[pos]) / count(*)) AS BIGINT) AS v
                        FROM a{i} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part, generate_series(1, len(p.x)) AS s(pos) GROUP BY ALL
                    ) GROUP BY ALL
                ) m ON m.part = b.part AND m.entry = b.entry
            )"""
    steps = [book, near.format(i=0), move.format(i=0, j=1), near.format(i=1), move.format(i=1, j=2), near.format(i=2)]
    return (
        """
            WITH v AS MATERIALIZED (
                SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), p AS MATERIALIZED (
                SELECT vec_id, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS x FROM v, range(16) AS r(part)
            ),"""
        + ",".join(steps)
        + """, c AS (
                SELECT v.vec_id, v.label, string_agg(printf('%02x', a.best.entry), '' ORDER BY a.part) AS code, CAST(sum(a.best.d) AS BIGINT) AS error
                FROM v JOIN a2 a ON a.vec_id = v.vec_id GROUP BY ALL
            )
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
                (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
            FROM c"""
    )


_LAYOUT_SQL = """
            WITH d AS (
                SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length,
                    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                        lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)), lambda g, i: xor(g // 2, 3988292384::BIGINT * (g % 2)))), 4294967295::BIGINT) AS BIGINT) % 365 AS date
                FROM documents
            ), s AS MATERIALIZED (
                SELECT doc_id, CAST(8 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS INTEGER) AS a,
                    CAST(8 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS INTEGER) AS b,
                    CAST(8 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS INTEGER) AS c,
                    CAST(8 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // count(*) OVER () AS INTEGER) AS d
                FROM d
            ), z AS (
                SELECT *, list_sum(list_transform([2, 1, 0], lambda k:
                    (((a >> k) & 1) * 8 + ((b >> k) & 1) * 4 + ((c >> k) & 1) * 2 + ((d >> k) & 1)) << (4 * k)))::BIGINT AS z FROM s
            ), r AS MATERIALIZED (
                SELECT *, position // 1000 AS file FROM (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM z)
            ), f AS MATERIALIZED (
                SELECT file, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(d) AS d0, max(d) AS d1 FROM r GROUP BY file
            ), q AS MATERIALIZED (SELECT DISTINCT a, b, c, d FROM r), t AS (
                SELECT q.a, q.b, q.c, q.d, count(*) AS files_touched FROM q JOIN f
                ON q.a BETWEEN a0 AND a1 AND q.b BETWEEN b0 AND b1 AND q.c + 1 >= c0 AND q.c - 1 <= c1 AND q.d + 1 >= d0 AND q.d - 1 <= d1 GROUP BY ALL
            ), m AS (
                SELECT q.a, q.b, q.c, q.d, count(DISTINCT x.file) AS files_matching FROM q JOIN (SELECT DISTINCT a, b, c, d, file FROM r) x
                ON q.a = x.a AND q.b = x.b AND abs(q.c - x.c) <= 1 AND abs(q.d - x.d) <= 1 GROUP BY ALL
            )
            SELECT r.doc_id, r.z, r.position, r.file, t.files_touched, m.files_matching, concat_ws(',', a0, a1, b0, b1, c0, c1, d0, d1) AS file_bounds
            FROM r JOIN f USING (file) JOIN t USING (a, b, c, d) JOIN m USING (a, b, c, d)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others have brute-force tests."""
    return {
        "op11_vector_codes": _codes_sql(),
        "op12_zorder_layout": _LAYOUT_SQL,
        "op2_branch_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), p AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
            ), r AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p
            )
            SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
        "op7_multi_index": """
            WITH RECURSIVE v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            ), l AS (
                SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
                WHERE list_inner_product(a.e, b.e) >= 0.95 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))
            ), reach AS (
                SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
            ), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
            SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
            FROM v JOIN c ON c.x = v.vec_id""",
    }
