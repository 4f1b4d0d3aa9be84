"""Grain-preserving joins: lookups, pre-aggregated lookups, roles, row verification, key groups, interval lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.values import normalizer
from weft.operators.clustering import stored

ROW = "__row"


def with_row_numbers(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Dense 0-based ``__row``: by ``order_by`` if given, else in file order.

    Ranges are sorted in parallel and each partition's rows start at the count of rows in the partitions before it, so
    no task sees more than its own range.
    """
    ranged = df if order_by is None else df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    local = Window.partitionBy("__part").orderBy("__at")
    placed = stored(placed.withColumn("__n", F.row_number().over(local)))  # counts and rows must see one placing
    counts = placed.groupBy("__part").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__skip"))
    out = placed.join(F.broadcast(offsets), "__part")  # one row a partition
    return out.withColumn(ROW, (F.col("__n") + F.col("__skip") - 1).cast("long")).drop("__part", "__at", "__n", "__skip", "__c")


def first_by_key(df: DataFrame, key: Column, order: Column | str = ROW) -> DataFrame:
    """One row for each non-null key: the first by ``order``. Adds ``__ck``.

    The choice is an aggregate, not a window, so that a hot key is combined before the shuffle.
    """
    cols = [F.col(c) for c in df.columns]
    o = F.col(order) if isinstance(order, str) else order
    picked = (df.select(key.alias("__ck"), F.struct(*cols).alias("__r"), o.alias("__o")).where("__ck IS NOT NULL")
              .groupBy("__ck").agg(F.min_by("__r", "__o").alias("__r")))
    return picked.select("__ck", "__r.*")


def lookup(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, alias: str, columns: dict[str, str] | None = None,
           norm: str | None = None, order: str = ROW, flags: bool = True) -> DataFrame:
    """Left join that never multiplies parent rows.

    Keys are compared under the same normaliser (``norm``; None: as they are); null keys never match; of several child
    rows with one key the first by ``order`` counts. ``columns`` maps child columns to output names (default: all, with
    ``alias_``). Adds ``_match_<alias>`` and, where the child has it, ``_src_<alias>_row``.
    """
    fn = normalizer(norm) if norm else (lambda c: c)
    columns = columns or {c: f"{alias}_{c}" for c in child.columns if c != ROW}
    keep = list(dict.fromkeys([*columns, *([ROW] if ROW in child.columns else []), *([order] if order in child.columns else [])]))
    base = child.select(*dict.fromkeys([*keep, child_key]))
    one = first_by_key(base, fn(F.col(child_key)), order if order in child.columns else F.lit(0))
    named = [F.col(c).alias(n) for c, n in columns.items()]
    if ROW in child.columns:
        named.append(F.col(ROW).alias(f"_src_{alias}_row"))
    right = one.select("__ck", *named)
    joined = parent.withColumn("__pk", fn(F.col(parent_key))).join(right, F.col("__pk") == F.col("__ck"), "left")
    if flags:
        joined = joined.withColumn(f"_match_{alias}", F.col("__ck").isNotNull())
    return joined.drop("__pk", "__ck")


@dataclass(frozen=True)
class Aggregate:
    """``function`` in sum, avg, min, max, count, count_distinct, mode; ``through``: pass the value if it is the same all over the group."""

    column: str
    function: str
    name: str
    through: bool = False


def _aggregate(a: Aggregate) -> Column:
    c = F.col(a.column)
    made = {
        "sum": lambda: F.sum(c), "avg": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(c),
        "count_distinct": lambda: F.count_distinct(c),
    }[a.function]()
    if a.through:
        # min = max says that a value depends on the key alone, without a second distinct count. Numbers pass as doubles.
        same = F.min(c).eqNullSafe(F.max(c))
        if a.function in ("sum", "avg", "count_distinct"):
            made = F.when(same, F.min(c.try_cast("double"))).otherwise(made.cast("double"))
        else:
            made = F.when(same, F.min(c)).otherwise(made)
    return made.alias(a.name)


def aggregate_to_key(child: DataFrame, key: Column, aggregates: list[Aggregate], count_name: str) -> DataFrame:
    """``child`` at the grain of ``key`` (null keys left out), with a record count."""
    plain = [a for a in aggregates if a.function != "mode"]
    modes = [a for a in aggregates if a.function == "mode"]
    keyed = child.withColumn("__ck", key).where("__ck IS NOT NULL")
    out = keyed.groupBy("__ck").agg(*[_aggregate(a) for a in plain], F.count("*").alias(count_name))
    for a in modes:  # frequencies first: bounded rows a key and deterministic ties
        freq = keyed.where(F.col(a.column).isNotNull()).groupBy("__ck", a.column).agg(F.count("*").alias("__n"))
        best = freq.groupBy("__ck").agg(F.min_by(a.column, F.struct(-F.col("__n"), F.col(a.column))).alias(a.name))
        out = out.join(best, "__ck", "left")
    return out


def aggregate_lookup(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, alias: str, aggregates: list[Aggregate], norm: str | None = None) -> DataFrame:
    """Left join of ``child`` aggregated to the key: parent rows stay as they are. Adds ``_match_`` and ``<alias>_record_count``."""
    fn = normalizer(norm) if norm else (lambda c: c)
    grouped = aggregate_to_key(child, fn(F.col(child_key)), aggregates, f"{alias}_record_count")
    joined = parent.withColumn("__pk", fn(F.col(parent_key))).join(grouped, F.col("__pk") == F.col("__ck"), "left")
    return joined.withColumn(f"_match_{alias}", F.col("__ck").isNotNull()).drop("__pk", "__ck")


def roles(parent: DataFrame, child: DataFrame, child_key: str, references: dict[str, str], columns: list[str], norm: str | None = None) -> DataFrame:
    """One lookup for each role: ``references`` maps role names to parent columns; the child is prepared once."""
    for role, reference in references.items():
        parent = lookup(parent, child, reference, child_key, role, {c: f"{role}_{c}" for c in columns}, norm)
    return parent


def final_columns(df: DataFrame, root: str, confidences: dict[str, float], entity_confidences: list[str] | None = None) -> DataFrame:
    """``_record_id``, ``_match_confidence`` (least of the matched lookups), ``_match_probability``, ``_relationship_confidence``."""
    matched = [F.when(F.col(f"_match_{a}"), F.lit(c)) for a, c in confidences.items()]
    product = F.lit(1.0)
    for a, c in confidences.items():
        product = product * F.when(F.col(f"_match_{a}"), F.lit(c)).otherwise(F.lit(1.0))
    probability = F.lit(1.0)
    for c in entity_confidences or []:
        probability = probability * F.coalesce(F.col(c), F.lit(1.0))
    return df.withColumns({
        "_record_id": F.concat(F.lit(f"{root}:"), F.col(ROW).cast("string")) if ROW in df.columns else F.lit(None).cast("string"),
        "_match_confidence": F.array_min(F.array(*matched)) if matched else F.lit(None).cast("double"),
        "_match_probability": probability,
        "_relationship_confidence": product,
    })


def match_statistics(df: DataFrame, aliases: list[str]) -> DataFrame:
    """(alias, rows, matched) for each match flag, in one pass."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(f"_match_{a}").alias(a) for a in aliases])
    return counted.select("rows", F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.col(a).alias("matched")) for a in aliases])).alias("x")).select("x.alias", "rows", "x.matched")


def sample_by_hash(df: DataFrame, key: Column, n: int, seed: str = "") -> DataFrame:
    """The ``n`` rows with the smallest MD5 of ``key``: the same rows whatever the partitioning."""
    return df.withColumn("__h", F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))).orderBy("__h").limit(n).drop("__h")


def agreement(left: DataFrame, right: DataFrame, left_key: str, right_key: str, pairs: list[tuple[str, str]], norm: str = "basic",
              sample: int | None = 20_000, order: str = ROW) -> DataFrame:
    """How often attribute pairs agree on joined rows: (left_column, right_column, compared, agreed).

    Numbers agree within a relative 1e-6, dates at their shared precision, everything else normalised. Rows with a null
    on either side are not compared. All pairs are measured in one aggregate over one join.
    """
    if sample is not None:
        left = sample_by_hash(left, F.col(left_key), sample)
    fn = normalizer(norm)
    one = first_by_key(right.select(*dict.fromkeys([right_key, *[b for _, b in pairs], *([order] if order in right.columns else [])])),
                       fn(F.col(right_key)), order if order in right.columns else F.lit(0))
    renamed = one.select("__ck", *[F.col(b).alias(f"__r{i}") for i, (_, b) in enumerate(pairs)])
    joined = left.withColumn("__pk", fn(F.col(left_key))).join(renamed, F.col("__pk") == F.col("__ck"))
    types = dict(left.dtypes) | {f"__r{i}": dict(right.dtypes)[b] for i, (_, b) in enumerate(pairs)}
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    measures = []
    for i, (a, _) in enumerate(pairs):
        x, y = F.col(a), F.col(f"__r{i}")
        ta, tb = types[a], types[f"__r{i}"]
        if ta.startswith(numeric) and tb.startswith(numeric):
            agree = F.abs(x.cast("double") - y.cast("double")) <= 1e-6 * F.greatest(F.abs(x.cast("double")), F.abs(y.cast("double")))
        elif ta.startswith(("date", "timestamp")) and tb.startswith(("date", "timestamp")):
            agree = x.cast("date") == y.cast("date") if "date" in (ta, tb) else x == y
        else:
            agree = fn(x) == fn(y)
        both = x.isNotNull() & y.isNotNull()
        measures += [F.count_if(both).alias(f"__n{i}"), F.count_if(both & agree).alias(f"__a{i}")]
    got = joined.agg(*measures)
    rows = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"__n{i}").alias("compared"), F.col(f"__a{i}").alias("agreed"))
            for i, (a, b) in enumerate(pairs)]
    return got.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def interval_at(history: DataFrame, moment: Column) -> DataFrame:
    """Rows whose validity holds at ``moment``: valid_from <= moment < valid_to (open ends count)."""
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def as_of(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, columns: list[str]) -> DataFrame:
    """For every probe the latest fact of its key at or before its time, by one union, sort and carry-forward."""
    p = probes.withColumns({"__k": F.col(key), "__t": F.col(probe_time), "__side": F.lit(1)})
    value = F.struct(*[F.col(c) for c in columns])
    left = p.select("__k", "__t", "__side", F.struct(*probes.columns).alias("__p"), F.lit(None).cast(facts.select(value.alias("x")).schema["x"].dataType).alias("__f"))
    right = facts.select(F.col(key).alias("__k"), F.col(fact_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__p"].dataType).alias("__p"), value.alias("__f"))
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = left.unionByName(right).withColumn("__f", F.last("__f", ignorenulls=True).over(w)).where("__side = 1")
    return carried.select("__p.*", *[F.col(f"__f.{c}").alias(f"asof_{c}") for c in columns])


def key_groups(records: DataFrame, keys: list[str], norm: str = "identifier") -> DataFrame:
    """Groups of records that share a normalised key, transitively over several key columns: adds ``group_id``.

    ``records`` has ``rid``. A null key joins nothing. With one key column no iteration is needed.
    """
    from weft.operators.clustering import components

    fn = normalizer(norm)
    if len(keys) == 1:
        k = fn(F.col(keys[0]))
        least = records.select(k.alias("__k"), "rid").where("__k IS NOT NULL").groupBy("__k").agg(F.min("rid").alias("__g"))
        return records.withColumn("__k", k).join(least, "__k", "left").withColumn("group_id", F.coalesce("__g", "rid")).drop("__k", "__g")
    long = None
    for c in keys:
        part = records.select("rid", F.concat(F.lit(c + "="), fn(F.col(c))).alias("__k")).where("__k IS NOT NULL")
        long = part if long is None else long.unionByName(part)
    hubs = long.groupBy("__k").agg(F.min("rid").alias("hub"))
    edges = long.join(hubs, "__k").where("rid != hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    labels = components(records.select(F.col("rid").alias("node")), edges)
    return records.join(labels.select(F.col("node").alias("rid"), F.col("label").alias("group_id")), "rid")
