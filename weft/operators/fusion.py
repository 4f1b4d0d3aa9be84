"""Conflict resolution over candidate values, source accuracy, entity tables, and attribute history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.values import normalizer

STRATEGIES = ("majority_vote", "prefer_source", "prefer_latest", "prefer_non_null", "highest_confidence", "source_accuracy_vote", "keep_all", "manual_review")


def candidate_values(members: DataFrame, attributes: dict[str, str], value_norms: dict[str, str] | None = None) -> DataFrame:
    """Members (entity_id, dataset, row, priority, ts, confidence, attributes …) as one row for each non-null value.

    ``attributes`` maps output names to columns. Adds ``norm``, by which values agree or conflict.
    """
    norms = value_norms or {}
    cells = [F.struct(F.lit(n).alias("attribute"), F.col(c).cast("string").alias("value")) for n, c in attributes.items()]
    base = ["entity_id", "dataset", "row", "priority", "ts", "confidence"]
    rows = members.select(*base, F.explode(F.array(*cells)).alias("x")).select(*base, "x.*").where("value IS NOT NULL")
    # One normaliser for all attributes that share it, so that the expression does not grow with them.
    norm = normalizer(None)(F.col("value"))
    for name in sorted({v for v in norms.values() if v and normalizer(v) is not normalizer(None)}):
        norm = F.when(F.col("attribute").isin(*[n for n in attributes if norms.get(n) == name]), normalizer(name)(F.col("value"))).otherwise(norm)
    return rows.withColumn("norm", norm).where("norm IS NOT NULL")


def _voted(c: DataFrame, weight: Column) -> DataFrame:
    """The value with the most weight in its group; ties take the best priority, then the first row."""
    votes = c.groupBy("entity_id", "attribute", "norm").agg(F.round(F.sum(weight), 9).alias("votes"), F.min(F.struct("priority", "dataset", "row", "value")).alias("first"))
    best = votes.groupBy("entity_id", "attribute").agg(F.min_by(F.col("first.value"), F.struct((-F.col("votes")).alias("v"), "first")).alias("resolved"))
    return best


def resolved_values(candidates: DataFrame, strategy: str, accuracy: DataFrame | None = None) -> DataFrame:
    """(entity_id, attribute, resolved, n_values, n_candidates, conflict) under one of the strategies.

    Where all values agree the first (by priority, dataset, row) stands whatever the strategy. Everything is a grouped
    aggregate, so a hot entity is combined before the shuffle. Ties: majority by votes, then priority, dataset, row;
    latest by time, then priority; confidence likewise. ``keep_all`` gives a JSON list, ``manual_review`` null.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    c = candidates
    rank = F.struct("priority", "dataset", "row")
    groups = c.groupBy("entity_id", "attribute").agg(
        F.min("norm").alias("__lo"), F.max("norm").alias("__hi"), F.count("*").alias("n_candidates"), F.min_by("value", rank).alias("__first"),
        F.max_by("value", F.struct("ts", (-F.col("priority")).alias("p"), F.lit(0).alias("z"))).alias("__latest"), F.min_by("value", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "priority", "dataset", "row")).alias("__sure"))
    distinct = c.groupBy("entity_id", "attribute", "norm").agg(F.min_by("value", rank).alias("v"), F.min(rank).alias("r")).groupBy("entity_id", "attribute").agg(
        F.count("*").alias("n_values"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"])).alias("__all"))
    out = groups.join(distinct, ["entity_id", "attribute"])
    if strategy in ("majority_vote", "source_accuracy_vote"):
        if strategy == "source_accuracy_vote":
            if accuracy is None:
                raise ValueError("source_accuracy_vote needs source accuracies")
            a = F.least(F.greatest(F.coalesce("accuracy", F.lit(0.8)), F.lit(0.01)), F.lit(0.99))
            c = c.join(F.broadcast(accuracy), "dataset", "left")  # one row a source
            weight = F.log(a / (1 - a))
        else:
            weight = F.lit(1.0)
        out = out.join(_voted(c, weight), ["entity_id", "attribute"])
        value = F.col("resolved")
    else:
        value = {"prefer_source": F.col("__first"), "prefer_non_null": F.col("__first"), "prefer_latest": F.coalesce("__latest", "__first"),
                 "highest_confidence": F.col("__sure"), "keep_all": F.col("__all"), "manual_review": F.lit(None).cast("string")}[strategy]
    conflict = ~F.col("__lo").eqNullSafe(F.col("__hi"))
    return out.select("entity_id", "attribute", F.when(conflict, value).otherwise(F.col("__first")).alias("resolved"), "n_values", "n_candidates", conflict.alias("conflict"))


def conflicts(candidates: DataFrame, strategy: str, accuracy: DataFrame | None = None) -> DataFrame:
    """One row for each conflict, with all candidates, the resolved value, strategy and status."""
    found = resolved_values(candidates, strategy, accuracy).where("conflict")
    listed = candidates.groupBy("entity_id", "attribute").agg(F.array_sort(F.collect_list(F.struct("priority", "dataset", "row", "value", "norm", "ts", "confidence"))).alias("candidates"))
    return found.join(listed, ["entity_id", "attribute"]).withColumns({"strategy": F.lit(strategy), "status": F.when(F.lit(strategy == "manual_review"), "open").otherwise("resolved")})


def cell_provenance(candidates: DataFrame, strategy: str, accuracy: DataFrame | None = None) -> DataFrame:
    """(entity_id, attribute, source_dataset, source_row, strategy, reason) of each fused cell with several candidates:
    whose value it is, the best by priority, dataset and row of those that gave it. Lists and open cells have no winner."""
    found = resolved_values(candidates, strategy, accuracy).where("n_candidates > 1 AND resolved IS NOT NULL")
    both = candidates.join(found, ["entity_id", "attribute"]).where("value = resolved")
    best = both.groupBy("entity_id", "attribute").agg(F.min(F.struct("priority", "dataset", "row")).alias("x"), F.first("conflict").alias("conflict"), F.first("n_values").alias("n_values"))
    return best.select("entity_id", "attribute", F.col("x.dataset").alias("source_dataset"), F.col("x.row").alias("source_row"),
                       F.when(F.col("conflict"), strategy).otherwise("agreement").alias("strategy"),
                       F.when(F.col("conflict"), F.concat(F.lit("chosen among "), F.col("n_values").cast("string"), F.lit(" values"))).otherwise("all sources agree").alias("reason"))


def united_histories(histories: list[tuple[object, DataFrame]]) -> DataFrame | None:
    """All histories in one, each row with the moment at which its merge recorded it."""
    out = None
    for at, h in histories:
        one = h.withColumn("recorded_at", F.lit(at).cast("timestamp_ntz"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def source_accuracy(candidates: DataFrame, rounds: int = 10, start: float = 0.8) -> DataFrame:
    """(dataset, accuracy): sources vote with log-odds of their accuracy, and an accuracy is the share of a source's
    values that win, with Laplace smoothing. Each round is one aggregate; a vector of sources is all that returns."""
    spark = candidates.sparkSession
    names = sorted(r["dataset"] for r in candidates.select("dataset").distinct().collect())
    accuracy = {n: start for n in names}
    by_norm = candidates.select("entity_id", "attribute", "norm", "dataset")
    for _ in range(rounds):
        frame = spark.createDataFrame(sorted(accuracy.items()), "dataset string, accuracy double")
        a = F.least(F.greatest("accuracy", F.lit(0.01)), F.lit(0.99))
        voted = by_norm.join(F.broadcast(frame), "dataset").groupBy("entity_id", "attribute", "norm").agg(F.sum(F.log(a / (1 - a))).alias("w"))
        best = voted.groupBy("entity_id", "attribute").agg(F.min_by("norm", F.struct((-F.round("w", 9)).alias("w"), "norm")).alias("win"))
        counted = by_norm.join(best, ["entity_id", "attribute"]).groupBy("dataset").agg(F.count_if(F.col("norm") == F.col("win")).alias("right"), F.count("*").alias("n")).collect()
        new = {r["dataset"]: (r["right"] + 1) / (r["n"] + 2) for r in counted}
        if max(abs(new[n] - accuracy[n]) for n in names) < 1e-9:
            break
        accuracy = new
    return spark.createDataFrame(sorted(accuracy.items()), "dataset string, accuracy double")


def entity_records(candidates: DataFrame, members: DataFrame, attributes: list[str], strategy: str, accuracy: DataFrame | None = None) -> DataFrame:
    """One row for each entity: resolved attributes, ``_entity_sources`` (JSON), ``_entity_record_count``, ``_has_conflict``."""
    values = resolved_values(candidates, strategy, accuracy)
    wide = values.groupBy("entity_id").agg(*[F.max(F.when(F.col("attribute") == a, F.col("resolved"))).alias(a) for a in attributes], F.bool_or("conflict").alias("__conflict"))
    info = members.groupBy("entity_id").agg(F.count("*").alias("_entity_record_count"), F.to_json(F.array_sort(F.collect_set("dataset"))).alias("_entity_sources"),
                                            F.min("confidence").alias("_entity_confidence"))
    return info.join(wide, "entity_id", "left").withColumn("_has_conflict", F.coalesce("__conflict", F.lit(False))).drop("__conflict")


def attach_entities(anchor: DataFrame, assignment: DataFrame, entities: DataFrame, row: str = "__row") -> DataFrame:
    """Anchor rows with their entity's columns: anchor to assignment (row, entity_id), then to the entity table."""
    return anchor.join(assignment.select(F.col("row").alias(row), "entity_id"), row).join(entities, "entity_id")


def fused_number(function: str, c: Column) -> Column:
    """Numbers at entity grain: sums, counts and distinct counts add up (the last an upper bound), averages average."""
    return {"sum": F.sum, "count": F.sum, "count_distinct": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[function](c)


# -- history --------------------------------------------------------------------------------------------------------------


def history(values: DataFrame) -> DataFrame:
    """Validity intervals from (entity_id, attribute, value, norm, ts, priority, dataset).

    At one moment the best priority counts. Runs of equal normalised values are one interval, which ends where the next
    begins; the last is current. Undated values stay, with open validity and ``current`` false. Columns: entity_id,
    attribute, value, valid_from, valid_to, support, sources, current.
    """
    dated = values.where("ts IS NOT NULL")
    rank = F.struct("priority", "dataset", "value")
    moments = dated.groupBy("entity_id", "attribute", "ts").agg(F.min_by(F.struct("value", "norm", "dataset"), rank).alias("x")).select("entity_id", "attribute", "ts", "x.*")
    w = Window.partitionBy("entity_id", "attribute").orderBy("ts")
    changed = F.when(F.lag("norm").over(w).eqNullSafe(F.col("norm")), 0).otherwise(1)
    runs = moments.withColumn("__change", changed).withColumn("__run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("entity_id", "attribute", "__run").agg(F.min("ts").alias("valid_from"), F.min_by("value", "ts").alias("value"), F.count("*").alias("support"), F.array_sort(F.collect_set("dataset")).alias("sources"))
    v = Window.partitionBy("entity_id", "attribute").orderBy("valid_from")
    ends = spans.withColumn("valid_to", F.lead("valid_from").over(v)).withColumn("current", F.col("valid_to").isNull())
    cols = ["entity_id", "attribute", "value", "valid_from", "valid_to", "support", "sources", "current"]
    undated = values.where("ts IS NULL").groupBy("entity_id", "attribute", "norm").agg(F.min_by("value", rank).alias("value"), F.count("*").alias("support"), F.array_sort(F.collect_set("dataset")).alias("sources"))
    undated = undated.withColumns({"valid_from": F.lit(None).cast(dict(values.dtypes)["ts"]), "valid_to": F.lit(None).cast(dict(values.dtypes)["ts"]), "current": F.lit(False)})
    return ends.select(*cols).unionByName(undated.select(*cols))


def history_violations(h: DataFrame) -> DataFrame:
    """Rows that break the rules (none should): an interval that ends before it starts, overlaps its successor, or several current ones."""
    w = Window.partitionBy("entity_id", "attribute").orderBy("valid_from")
    dated = h.where("valid_from IS NOT NULL").withColumn("__next", F.lead("valid_from").over(w)).withColumn("__n", F.count_if(F.col("valid_to").isNull()).over(Window.partitionBy("entity_id", "attribute")))
    bad = (F.col("valid_to") <= F.col("valid_from")) | (F.col("__next").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("__next")))) | (F.col("__n") > 1)
    return dated.where(bad).drop("__next", "__n")


def history_at(h: DataFrame, moment: Column | None = None, entity: str | None = None, attribute: str | None = None) -> DataFrame:
    """The history filtered by entity, attribute and moment of validity; undated rows hold at no moment."""
    if entity is not None:
        h = h.where(F.col("entity_id") == entity)
    if attribute is not None:
        h = h.where(F.col("attribute") == attribute)
    if moment is not None:
        h = h.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))
    return h


def as_known_at(histories: list[tuple[object, DataFrame]], known_at) -> DataFrame | None:
    """Of (recorded_at, history) pairs the last recorded at or before ``known_at``."""
    known = [(t, h) for t, h in histories if t <= known_at]
    return max(known, key=lambda x: x[0])[1].withColumn("recorded_at", F.lit(max(t for t, _ in known))) if known else None


def changed_attributes(h: DataFrame) -> DataFrame:
    """(entity_id, attribute, intervals) of attributes with more than one dated interval."""
    return h.where("valid_from IS NOT NULL").groupBy("entity_id", "attribute").agg(F.count("*").alias("intervals")).where("intervals > 1")
