"""The queries of the training-data operators and the SQL that states the same, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folium.llm.contamination import contamination
from folium.llm.language import identify
from folium.llm.licenses import licenses
from folium.llm.mixing import mix_documents
from folium.llm.near_dups import near_duplicates
from folium.llm.quality import quality
from folium.llm.secrets import secret_digest
from folium.llm.shared import ready, table
from folium.llm.substrings import substring_dedup
from folium.llm.token_files import token_output
from folium.llm.topk import top_k


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ready(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        win AS (SELECT doc_id, i, md5(array_to_string(words[i:i+19], ' ')) AS h FROM p WHERE i <= len(words) - 19),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(0, 20) t(k)),
        kept AS (SELECT p.doc_id, array_to_string(list(p.words[p.i] ORDER BY p.i), ' ') AS text
                 FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id),
        runs AS (SELECT g.doc_id, count(*) AS n FROM gone g LEFT JOIN gone b ON b.doc_id = g.doc_id AND b.i = g.i - 1 WHERE b.i IS NULL GROUP BY g.doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(runs.n, 0)::BIGINT AS n_repeats
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op9_minhash_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [md5(array_to_string(words, ' '))]
                     ELSE list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i+4], ' '))) END) AS h FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.both >= 75 * (x.n + y.n - o.both)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
