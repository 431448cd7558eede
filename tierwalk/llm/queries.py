"""Queries of the training-data operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.llm import bpe, chunks, decontaminate, divergence, exact_dedup, gru, kmeans, linkgraph, media, ngram_join, sharding, tokenstore, toxicity
from tierwalk.llm.common import Work, table


def op1_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Work(spark, "ids").path("files")
    tokenstore.write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenstore.read(spark, out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.propagate(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.score(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(table(spark, sf_dir, "documents"))


def op9_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_kd_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, seed=3)


def op13_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_payloads(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_range_coded_ids, op2_toxicity, op3_byte_bpe, op4_label_propagation_shards, op5_gru_lm, op6_exact_dedup, op7_link_graph, op8_content_chunks, op9_suffix_decontamination, op10_ngram_jaccard, op11_source_divergence, op12_kd_tree_clusters, op13_lossless_webp, pipeline)
    return {f.__name__: f for f in own}


def _words(pattern: str) -> str:
    """SQL for the words of a text, A-Z lower-cased."""
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


def _kmeans_sql(k: int, rounds: int, width: int, seed: int) -> str:
    """Lloyd's rounds written out one after the other; the state of each is a row for each centroid's component."""
    nearest = """SELECT vec_id, row, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
                 SELECT row, any_value(vec_id) AS vec_id, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM v JOIN m{r} m USING (i) GROUP BY row, c) GROUP BY vec_id, row"""
    steps = [
        f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
                   WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
            v AS MATERIALIZED (SELECT row, vec_id, unnest(range({width})) AS i, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM e),
            s AS MATERIALIZED (SELECT row, (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::BIGINT AS c FROM e QUALIFY c < {k}),
            m0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN s USING (row))"""
    ]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({nearest.format(k=k, r=r)}),
            n{r} AS MATERIALIZED (SELECT c, i, sum(x)::BIGINT AS t, count(*) AS n FROM v JOIN (SELECT row, c FROM a{r}) USING (row) GROUP BY c, i),
            m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE (t - ((t % n) + n) % n) // n END AS x FROM m{r} m LEFT JOIN n{r} USING (c, i))""")
    steps.append(f"""z AS MATERIALIZED ({nearest.format(k=k, r=rounds)})""")
    return ",\n            ".join(steps) + f"""
            SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
            FROM z JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c) USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op9_suffix_decontamination": rf"""
            WITH d AS (SELECT doc_id, {_words("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS l FROM documents),
            b AS (SELECT item_id, {_words("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS l FROM benchmark),
            bw AS (SELECT DISTINCT item_id, k, array_to_string(l[i + 1 : i + k], ' ') AS w
                   FROM (SELECT item_id, l, least(10, len(l)) AS k, unnest(range(len(l) - least(10, len(l)) + 1)) AS i FROM b WHERE len(l) > 0)),
            dw AS (SELECT doc_id, k, i, array_to_string(l[i + 1 : i + k], ' ') AS w
                   FROM (SELECT doc_id, l, k, unnest(range(len(l) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(l) >= k)),
            h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, w)),
            p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY 1),
            t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
            SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
        "op10_ngram_jaccard": rf"""
            WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words("[^\x20\x09-\x0D]+")} AS l FROM documents),
            s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(l[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(greatest(len(l) - 3, 1))) AS i FROM d WHERE len(l) > 0)),
            n AS MATERIALIZED (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY 1),
            c AS MATERIALIZED (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY 1),
            r AS MATERIALIZED (SELECT doc_id, g FROM s WHERE doc_id IN (SELECT rep FROM c)),
            e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM r x JOIN r y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
                  JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b WHERE 100 * o >= 85 * (ca.n + cb.n - o)),
            w AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node),
            m AS (SELECT node, min(root) AS root FROM w GROUP BY 1)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id)::BIGINT AS component_id
            FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN m ON m.node = c.rep""",
        "op11_source_divergence": rf"""
            WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_words("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS l FROM documents),
            w AS MATERIALIZED (SELECT row, lang, source, unnest(l) AS term FROM d),
            k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
            n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
            c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n, lang_n FROM (SELECT DISTINCT lang, source FROM d) g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
            p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS p, 1 + (1000000000 * (lang_n + 1)) // (sum(n) OVER l + count(*) OVER g) AS q
                  FROM c WINDOW g AS (PARTITION BY lang, source), l AS (PARTITION BY lang)),
            s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            o AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
            t AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
            SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM o
            UNION ALL (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM t QUALIFY rank <= 200)""",
        "op12_kd_tree_clusters": _kmeans_sql(8, 10, 64, 3),
    }
