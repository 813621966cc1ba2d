"""One query for each corpus operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import inputs
from .exact_dedup import exact_dedup
from .jaccard import jaccard_join
from .kdtree import exact_top_k, integer_vector
from .language import identify_languages
from .mixing import mix_sources
from .packing import pack
from .secrets import scan_secrets
from .suffix import remove_repeats
from .token_files import token_files
from .toxicity import score_toxicity


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inputs(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector("embedding").alias("v"))
    return exact_top_k(spark, vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(spark, inputs(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, inputs(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, inputs(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_join(spark, inputs(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "rep_id", "n_links")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, inputs(spark, sf_dir, "documents")).drop("span_begin", "span_end")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark, inputs(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark, inputs(spark, sf_dir, "documents")).drop("all_spans")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sources(spark, inputs(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(inputs(spark, sf_dir, "documents"), inputs(spark, sf_dir, "labels"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op1_exact_top_k": r"""
        WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v::DOUBLE[], e.v::DOUBLE[])::BIGINT AS score
                   FROM e AS q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                   FROM documents),
             r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
             g AS (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
                          lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM d WHERE len(w) > 0),
             s AS (SELECT g, min(doc_id) AS rep_id, count(*) AS copies, len(g) AS n FROM g GROUP BY g),
             x AS (SELECT rep_id, n, copies, unnest(g) AS t FROM s),
             p AS (SELECT a.rep_id AS a, b.rep_id AS b, any_value(b.copies) AS copies FROM x AS a JOIN x AS b ON a.t = b.t AND a.rep_id <> b.rep_id
                   GROUP BY 1, 2, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
             c(node, class_id) AS (SELECT rep_id, rep_id FROM s UNION SELECT p.a, c.class_id FROM c JOIN p ON p.b = c.node),
             r AS (SELECT node, min(class_id) AS class_id FROM c GROUP BY 1),
             l AS (SELECT a, sum(copies)::BIGINT AS links FROM p GROUP BY 1)
        SELECT g.doc_id, r.class_id, s.rep_id, coalesce(l.links, 0) + s.copies - 1 AS n_links
        FROM g JOIN s USING (g) JOIN r ON r.node = s.rep_id LEFT JOIN l ON l.a = s.rep_id
        UNION ALL SELECT doc_id, doc_id, doc_id, 0 FROM d WHERE len(w) = 0""",
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, unnest(generate_series(0, length(h) // 2 - 50)) AS p, h FROM d WHERE length(h) >= 100),
             k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS k FROM w),
             m AS (SELECT doc_id, p FROM k QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
             e AS (SELECT *, CASE WHEN p > lag(p) OVER o + 50 THEN 1 ELSE 0 END AS cut FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
             i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM e),
             r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY 1, 2),
             q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
             t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
                          string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)""",
    "op9_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
             r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
             w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
             l AS (SELECT *, cap / weight AS level,
                          1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) AS budget FROM w),
             u AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                          (sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM l),
             o AS (SELECT *, (budget - used) / rest AS rate FROM u),
             t AS (SELECT source, place, source_size,
                          coalesce(least(cap, (SELECT arg_min(rate, (level, place)) FROM o WHERE rate < level) * weight), cap) AS target FROM o),
             q AS (SELECT d.doc_id, d.size, d.h, t.source_size, t.target, t.place,
                          (sum(d.size) OVER (PARTITION BY t.place ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS e
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             x AS (SELECT *, (e + turn * source_size) / CASE WHEN target > 0 THEN target END AS finish
                   FROM q CROSS JOIN (SELECT unnest([0, 1]) AS turn)),
             c AS (SELECT *, (sum(size) OVER (ORDER BY finish, place, turn, h, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS up_to,
                          (SELECT floor(sum(target)) FROM t)::BIGINT AS budget FROM x WHERE finish IS NOT NULL),
             k AS (SELECT doc_id, place, e, sum(greatest(0, least(size, size - (up_to - budget)))) AS taken FROM c GROUP BY ALL)
        SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
        FROM q LEFT JOIN k ON k.doc_id = q.doc_id AND k.place = q.place AND k.e = q.e""",
}
