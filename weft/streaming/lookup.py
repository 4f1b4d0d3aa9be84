"""A static merge plan over a stream: each micro-batch of the root is looked up in static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.values import normalizer
from weft.operators.joins import ROW, first_by_key


def stream_lookup(stream: DataFrame, child: DataFrame, stream_key: str, child_key: str, alias: str, columns: dict[str, str], norm: str | None = None) -> DataFrame:
    """The streaming side of a lookup: a stream-static left join on keys deduplicated beforehand; rows are never multiplied."""
    fn = normalizer(norm) if norm else (lambda c: c)
    one = first_by_key(child, fn(F.col(child_key)), ROW if ROW in child.columns else F.lit(0))
    right = one.select("__ck", *[F.col(c).alias(n) for c, n in columns.items()])
    joined = stream.withColumn("__pk", fn(F.col(stream_key))).join(right, F.col("__pk") == F.col("__ck"), "left")
    return joined.withColumn(f"_match_{alias}", F.col("__ck").isNotNull()).drop("__pk", "__ck")
