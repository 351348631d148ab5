"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.llm import centroids, exact_dedup, langid, ngram_join, packing, periodic_runs, pii, sentencepiece_scan, simhash, substring_dedup, topk, toxicity, warc
from lekha.plans.shared import new_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.summary(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id", "class_id", "links")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = langid.held_out(parts=4, part=2)
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted", "best_clause")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document in ten by its id repeats a part of its words with a period, to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words").cast("bigint")).withColumn("a", F.expr("if(n > 0, g % nullif(n, 0), 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_periods(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    more = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    best = F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"), most=4, words=4)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.quantised(table(spark, sf_dir, "embeddings"), scale=1024, dims=64)
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return centroids.cluster(vectors, key, k=8, rounds=10).withColumn("centroid_sha256", centroids.digest(F.col("centroid"))).drop("centroid")


QUERIES = {
    "op1_warc": op1_warc, "op2_sentencepiece": op2_sentencepiece, "op3_ngram_join": op3_ngram_join, "op4_topk": op4_topk, "op5_langid": op5_langid,
    "op6_toxicity": op6_toxicity, "op7_packing": op7_packing, "op8_exact_dedup": op8_exact_dedup, "op9_substring_dedup": op9_substring_dedup, "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs, "op12_simhash": op12_simhash, "op13_centroids": op13_centroids,
}



def _rounds(rounds: int = 10) -> str:
    """SQL of the rounds of centroid clustering, a step each."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, v, j, far FROM (SELECT row, vec_id, v, j, CAST({far} AS BIGINT) AS far, row_number() OVER (PARTITION BY row ORDER BY CAST({far} AS BIGINT), j) AS r FROM kept, c{k}) WHERE r = 1)")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT j, coalesce(list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) FILTER (n IS NOT NULL), any_value(c)) AS c FROM c{k} LEFT JOIN (
                SELECT j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 65)) AS i) GROUP BY j, i) USING (j) GROUP BY j)""")
    return ", ".join(steps)


SQL = {
    "op13_centroids": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT j - 1 AS j, c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) AS j, v AS c FROM kept) WHERE j <= 8),
        {_rounds()}
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a10 JOIN c10 USING (j)""",
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w),
        d AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS digest FROM s GROUP BY doc_id),
        c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY digest) AS class_id FROM d),
        h AS (SELECT s.doc_id, x, n FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM p WHERE 100 * k >= 90 * (nu + nv - k)),
        r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
        m AS (SELECT node, min(root) AS root FROM r GROUP BY node), l AS (SELECT u, count(*) AS links FROM e GROUP BY u)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0) AS links, coalesce(root, class_id, doc_id) AS component_id
        FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN l ON l.u = class_id LEFT JOIN m ON m.node = class_id""",
    "op1_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        w AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM w""",
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        w AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
}
