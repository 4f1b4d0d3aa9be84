"""Aggregates that carry the uncertainty of links, and scenarios in which a relationship is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTIONS = ("sum", "count", "avg")


def aggregate_with_uncertainty(unified: DataFrame, function: str, measure: str | None = None, group_by: str | None = None, certain_at: float = 0.9, limit: int | None = None,
                               scenarios: dict[str, str] | None = None, probability: str = "_match_probability", reliability: str = "_relationship_confidence") -> DataFrame:
    """Point, expected value, standard deviation, 95% bounds and certain-only value of an aggregate, all in one pass.

    Rows count with their link probability p: the expected sum is sum(p x), its variance sum(p (1 - p) x²). Averages
    have no bounds. ``scenarios`` maps names to flags; a scenario's value leaves out the rows that the flag marks.
    """
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function {function!r}")
    p = F.coalesce(F.col(probability), F.lit(1.0))
    x = F.lit(1.0) if function == "count" else F.col(measure).cast("double")
    there = x.isNotNull()
    certain = p >= certain_at
    point = {"sum": F.sum(x), "count": F.count("*").cast("double"), "avg": F.avg(x)}[function]
    expected = F.sum(p * x) / F.sum(F.when(there, p)) if function == "avg" else F.sum(p * x)
    only = {"sum": F.sum(F.when(certain, x)), "count": F.count_if(certain).cast("double"), "avg": F.avg(F.when(certain, x))}[function]
    made = [F.count("*").alias("rows"), point.alias("point"), expected.alias("expected"), F.sqrt(F.sum(p * (1 - p) * x * x)).alias("sd"), only.alias("certain_only"),
            F.avg(p).alias("mean_probability"), F.min(reliability).alias("min_relationship_confidence")]
    for name, flag in (scenarios or {}).items():
        kept = ~F.coalesce(F.col(flag), F.lit(False))
        value = {"sum": F.coalesce(F.sum(F.when(kept, x)), F.lit(0.0)), "count": F.count_if(kept).cast("double"), "avg": F.avg(F.when(kept, x))}[function]
        made.append(value.alias(f"if_{name}_wrong"))
    out = unified.groupBy(group_by).agg(*made) if group_by else unified.agg(*made)
    bounds = function != "avg"
    out = out.withColumns({"sd": F.when(F.lit(bounds), F.col("sd")), "low": F.when(F.lit(bounds), F.col("expected") - 1.96 * F.col("sd")), "high": F.when(F.lit(bounds), F.col("expected") + 1.96 * F.col("sd"))})
    if group_by:
        out = out.orderBy(F.desc_nulls_last("point"), group_by)
        out = out.limit(limit) if limit else out
    return out


def uncertain_rows(unified: DataFrame, tau: float = 0.9, probability: str = "_match_probability") -> DataFrame:
    """(expected_rows, rows_below): the sum of probabilities and the rows below ``tau``."""
    return unified.agg(F.sum(probability).alias("expected_rows"), F.count_if(F.col(probability) < tau).alias("rows_below"))
