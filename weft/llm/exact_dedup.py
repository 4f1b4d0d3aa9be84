"""Exact deduplication by progressive refinement [native].

Texts are grouped by byte length of the normalised text, then by a hash of its first characters, and only texts
that still share both with another text are hashed in full. Every step is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import collapsed, row_hash, without_rows, written

#: Characters of the normalised text in the prefix hash.
PREFIX_CHARS = 256
#: Up to so many surviving lengths or (length, prefix hash) keys, 24 bytes each, their table is broadcast; beyond, both
#: sides are shuffled on the key, lengths by salted keys.
MAX_BROADCAST_KEYS = 500_000
SALTS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                     max_broadcast_keys: int = MAX_BROADCAST_KEYS, digests: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, n_bytes and prefix_hash of the normalised text, and
    row_hash (a hash of the whole normalised text, which tells rows of one id apart).

    Equal means identical after each run of white space became one space; null text counts as empty, so null and
    empty texts form one group. The smallest id of a group stays. Ties cannot arise between distinct ids; rows that
    repeat an id with an equal text count each in group_size and are all marked kept if theirs is the smallest id.
    Rows that repeat an id with another text are judged by their own text. A null id never wins over another id; a group
    of null ids only has a null keep_id and its rows are kept. An empty table gives an empty result. Other columns are
    not read, whatever their names. ``digests`` adds text_sha256 of every row, read in the same pass.
    """
    norm = collapsed(F.col(text_col))
    src = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    src = src.select("_id", "_norm", F.octet_length("_norm").cast("long").alias("_n"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_p"))
    keys = written(src.select("_n", "_p"), "exact-keys")

    by_length = written(keys.groupBy("_n").agg(F.count("*").alias("_c")).where("_c > 1").select("_n"), "exact-lengths")
    if by_length.count() <= max_broadcast_keys:
        same_length = keys.join(F.broadcast(by_length), "_n", "left_semi")
    else:  # a length may hold a third of all rows
        salts = by_length.select("_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        same_length = keys.withColumn("_salt", F.pmod(F.hash("_p"), F.lit(SALTS))).join(salts, ["_n", "_salt"], "left_semi")
    by_prefix = written(same_length.groupBy("_n", "_p").agg(F.count("*").alias("_c")).where("_c > 1").select("_n", "_p"), "exact-prefixes")
    small = by_prefix.count() <= max_broadcast_keys
    wanted = by_prefix.toDF("_wn", "_wp")
    wanted = F.broadcast(wanted) if small else wanted

    sha = F.sha2(F.col("_norm").cast("binary"), 256)
    full = F.when(F.col("_wn").isNotNull(), sha)
    more = {"text_sha256": sha} if digests else {}
    told = src.join(wanted, (F.col("_n") == F.col("_wn")) & (F.col("_p") == F.col("_wp")), "left").select(
        "_id", "_n", "_p", F.xxhash64("_norm").alias("row_hash"), full.alias("_sha"), *[c.alias(k) for k, c in more.items()])
    told = written(told, "exact-full")
    groups = told.where("_sha IS NOT NULL").groupBy("_sha").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups, "exact-groups")
    hashed = told.where("_sha IS NOT NULL").join(groups, "_sha", "left")
    alone = told.where("_sha IS NULL").withColumns({"keep_id": F.lit(None).cast(told.schema["_id"].dataType), "group_size": F.lit(None).cast("long")})
    out = hashed.unionByName(alone)
    keep, size = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"),
                      F.col("_n").alias("n_bytes"), F.col("_p").alias("prefix_hash"), "row_hash", *more)


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that another row repeats, all columns: of equal texts the row of the smallest id stays
    (null ids last), and one row where several repeat that id. Rows are dropped by id and text, never by id alone."""
    found = exact_duplicates(docs, id_col, text_col).where("group_size > 1").select(F.col(id_col).alias("id"), "row_hash", "kept")
    found = written(found, "exact-copies")
    repeated = found.where("kept").groupBy("id", "row_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "row_hash")
    return without_rows(docs, F.col(id_col), row_hash(collapsed(F.col(text_col))), found.where("NOT kept").select("id", "row_hash"), repeated)
