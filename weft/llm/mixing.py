"""Mixing sources to target weights by hash-threshold histograms [native].

Token counts are summed by source and hash bucket; a running sum finds the bucket in which each source's budget
ends; only that bucket is divided further. What remains is one threshold per source, and a filter on the hash
selects the documents without sorting them. Thresholds are nested: a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import collapsed, word_count, written

#: Source weights, repeated over the sources in code-point order (null last).
WEIGHTS = (5, 2, 1)
#: No source's target exceeds so many times its size.
MAX_REPEATS = 3
#: Hexadecimal digits of the hash that one refinement step reads (4096 buckets), and the number of steps.
STEP_DIGITS, STEPS = 3, 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target.

    The targets share the sum of all sizes by weight; a target stops at ``max_repeats`` times its source's size and
    the excess is reshared by weight until none is above, which is the water level at which capped sources and
    weights times level add up to the whole. One row per source, so the single-task windows stay small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    before = (Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
              .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    df = df.withColumn("level", rest / rest_w)
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    df = df.withColumn("final_level", F.max(free).over(everything))
    return df.select("source", "source_size",
                     F.least("cap", F.coalesce(F.col("final_level") * F.col("w"), F.col("cap"))).alias("target"))


def _digits(hash_col: str, step: int) -> Column:
    return F.conv(F.substring(hash_col, step * STEP_DIGITS + 1, STEP_DIGITS), 16, 10).cast("int")


def document_hash(id_: Column) -> Column:
    return F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, STEP_DIGITS * STEPS)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), document_hash(F.col(id_col)).alias("_hash"))
    return written(base, "mix-sizes")


def thresholds(base: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """By source: source_size, target, whole copies, and the hash below (and perhaps at) which one more copy is taken."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_repeats)
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_repeats)))).otherwise(F.lit(0))
    plan = plan.withColumn("copies", copies.cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(F.lit(0.0)))
    plan = written(plan.withColumn("prefix", F.lit("")), "mix-plan")

    for step in range(STEPS):
        inside = base.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))
                                      & F.col("_hash").startswith(F.col("p.prefix")) & (F.col("p.rest") > 0))
        buckets = (inside.select(F.col("b.source").alias("source"), _digits("_hash", step).alias("bucket"), "size")
                   .groupBy("source", "bucket").agg(F.sum("size").alias("words")))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = buckets.withColumn("upto", F.sum("words").over(running))
        sums = sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
            F.col("s.source").alias("source"), "bucket", "words", "upto", "rest")
        # The boundary bucket is the first whose running sum exceeds the budget.
        cut = (sums.where("upto > rest").groupBy("source")
               .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words"), "bucket").alias("c")))
        digits = F.lpad(F.lower(F.conv(F.col("c.bucket").cast("string"), 10, 16)), STEP_DIGITS, "0")
        plan = (plan.alias("p").join(cut.alias("c0"), F.col("p.source").eqNullSafe(F.col("c0.source")), "left")
                .select(F.col("p.source").alias("source"), "source_size", "target", "copies",
                        F.when(F.col("c").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("c.before")).alias("rest"),
                        F.when(F.col("c").isNull(), F.col("prefix")).otherwise(F.concat("prefix", digits)).alias("prefix"),
                        F.col("c.words").alias("edge")))
        plan = written(plan.drop("edge") if step < STEPS - 1 else plan, f"mix-plan{step}")

    # The last boundary holds one hash: it is taken if that comes nearer than leaving it.
    whole = F.length("prefix") == STEP_DIGITS * STEPS
    return plan.withColumn("with_edge", F.coalesce(whole & (F.col("edge") - F.col("rest") < F.col("rest")), F.lit(False)))


def _times(hash_: Column, max_repeats: float) -> Column:
    once_more = (hash_ < F.col("p.prefix")) | ((hash_ == F.col("p.prefix")) & F.col("p.with_edge"))
    return F.least(F.col("p.copies") + F.when(once_more, 1).otherwise(0), F.lit(int(max_repeats)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target, taken (size times the copies the mix takes).

    A source whose target is k times its size and a remainder takes every document k times and a hash-chosen part
    once more; the remainder is met as nearly as whole documents (or rows of one hash) allow, and at most
    ``max_repeats`` copies are taken. The hash is the MD5 of the id as text, so reruns agree. Null text and text of
    white space have size 0 and are never taken; null sources are one source, ordered last; null ids and repeated
    rows share a hash and are taken together. Ties of the nearest threshold take fewer words. Extra columns are not
    read; an empty table gives an empty result.
    """
    base = sized(docs, id_col, text_col, source_col)
    joined = base.alias("b").join(thresholds(base, weights, max_repeats).alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    return joined.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * _times(F.col("_hash"), max_repeats)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken (a row per copy), with all columns of ``docs``.

    Documents without words are not taken. The thresholds, one row a source, are joined to the documents, so that texts
    stay where they are; rows that repeat an id are decided alike.
    """
    plan = thresholds(sized(docs, id_col, text_col, source_col))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), document_hash(docs[id_col]).alias("hash"),
                         (F.trim(collapsed(docs[text_col])) != "").alias("has_words"))
    joined = packed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).where("d.has_words")
    copies = joined.select("d.row", _times(F.col("d.hash"), MAX_REPEATS).alias("times")).where("times > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
