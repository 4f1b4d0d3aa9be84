"""The thin opN queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bagminhash, exact_dedup, html_extract, kn_toxicity, mih_ann, mixing, packing, pii, ppm_langid, url_filter
from weft.llm.common import bounded_batches, table


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def _fold(col: str, modulus: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.fit(pages))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih_ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Labels are joined by broadcast up to so many rows (16 bytes each); beyond, both sides are shuffled.
MAX_BROADCAST_LABELS = 2_000_000


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.where(_fold("doc_id", 3) != 1)
    small = labels.count() <= MAX_BROADCAST_LABELS
    labelled = docs.join(F.broadcast(labels) if small else labels, "doc_id", "left")
    model = kn_toxicity.fit(labelled, F.col("toxic"), F.xxhash64("doc_id", F.lit(9)) % 5 == 0)
    out = kn_toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def language_model(docs: DataFrame) -> ppm_langid.PpmModel:
    known = docs.where(F.coalesce(_fold("doc_id", 5) != 0, F.lit(False)))
    return ppm_langid.fit(known, F.col("text"), F.col("lang"), F.col("doc_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = ppm_langid.identify(docs, language_model(docs))
    return out.select("doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_nearest_neighbours, op3_near_duplicates, op4_toxicity, op5_packing,
                                   op6_language_id, op7_personal_data, op8_url_filter, op9_exact_dedup, op10_mixing)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL = {
    "op9_exact_dedup": rf"""
WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""",
    "op10_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             3.0 * source_size AS cap FROM s),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv FROM w
       WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN lv * w <= cap THEN lv END) OVER () * w, cap)) AS target FROM lv),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS copies FROM tg),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target - copies * source_size ELSE 0 END AS rest FROM c),
k AS (SELECT d.source, d.h, sum(d.size) AS words FROM d GROUP BY d.source, d.h),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM k),
p AS (SELECT u.source, u.h, r.rest > 0 AND (u.upto <= r.rest OR (u.upto - u.words <= r.rest AND u.upto - r.rest < r.rest - (u.upto - u.words))) AS more
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * least(r.copies + CASE WHEN p.more THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.h = p.h""",
}
