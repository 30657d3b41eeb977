"""The registered queries of the training-data operators and, where SQL can state them, the SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks.registry import Registry
from . import bpe, conversations, decontaminate, line_dedup, merkle, near_duplicates, nearest, oracles, personal_data, quality, token_counts, url_filter, warc, wrappers

REG = Registry()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@REG.query("op1_decontamination", rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
 win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS t
         FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 sizes AS (SELECT DISTINCT n FROM win),
 p AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
 hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM p JOIN win USING (n, t)),
 spots AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@REG.query("op2_near_duplicates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@REG.query("op3_byte_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Rules of the query, fixed values.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@REG.query("op4_url_filter", f"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
 u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 m AS (SELECT page_id, host, path, h || p AS rule, v FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(v, length(rule)), 'allow') AS verdict FROM m GROUP BY page_id, host, path""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@REG.query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit_labels(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (quality.remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


BASE32 = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


@REG.query("op6_warc", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
 t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {BASE32[4:]} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM t""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@REG.query("op7_nearest")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@REG.query("op8_line_dedup", f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 k AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
 f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, coalesce(doc_id <> top, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@REG.query("op9_personal_data")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@REG.query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@REG.query("op11_main_text", oracles.main_text_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@REG.query("op12_merkle_manifest", oracles.manifest_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    made = merkle.manifest(table(spark, folder, "documents"), claims={"text": altered})
    checked = made.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("steps")))
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
                          (F.col("folded_root") == F.col("root")).alias("verified"))


@REG.query("op13_conversation_repair", oracles.repair_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")))


@REG.query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
