"""Approximate nearest neighbours by multi-index hashing.

A rotation learned by iterative quantisation turns vectors into 64-bit codes, split into eight substrings, each with an
index of its own. A code within Hamming radius r of a query has, by the pigeonhole principle, a substring within a few
bits of the query's; probing those buckets retrieves every code within r, and the retrieved are reranked by the exact
inner product. The index lies in blocks of bounded size and queries come in blocks too; a task joins one of each and
returns its best, so that no task holds more than two blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import written

BITS, SUBSTRINGS = 64, 8
#: Vectors that the rotation and the radius are learned from.
SAMPLE = 20_000
#: Recall at which the radius is set on the sample; the whole table's neighbours are nearer, so its recall is higher.
SAMPLE_RECALL = 0.97
INDEX_BLOCK, QUERY_BLOCK, LEAST_BLOCKS = 50_000, 10_000, 16


@dataclass
class HashModel:
    mean: np.ndarray
    projection: np.ndarray  # (dimensions, BITS)
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.projection > 0
        return np.packbits(bits, axis=1).view(np.uint64).ravel() if len(x) else np.zeros(0, np.uint64)


def learn(x: np.ndarray, k: int, rounds: int = 40, seed: int = 2, target: float = SAMPLE_RECALL) -> HashModel:
    """Iterative quantisation, then the radius that retrieves ``target`` of the sample's own k nearest neighbours."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(axis=0)
    z = x - mean
    _, vectors = np.linalg.eigh(z.T @ z)
    basis = vectors[:, ::-1]
    if d < BITS:  # more bits than dimensions: random directions are added
        extra = rng.normal(size=(d, BITS - d))
        basis = np.concatenate([basis, extra / np.linalg.norm(extra, axis=0)], axis=1)
    basis = basis[:, :BITS]
    v = z @ basis
    rotation = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        b = np.where(v @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        rotation = (left @ right).T
    model = HashModel(mean, basis @ rotation, BITS)
    queries = rng.choice(len(x), min(len(x), 300), replace=False)
    sims = x[queries] @ x.T
    sims[np.arange(len(queries)), queries] = -np.inf
    top = np.argpartition(-sims, min(k, len(x) - 1) - 1, axis=1)[:, :min(k, len(x) - 1)] if len(x) > 1 else np.zeros((0, 1), int)
    if top.size:
        codes = model.codes(x)
        distance = np.bitwise_count(codes[queries][:, None] ^ codes[top])
        model.radius = int(np.quantile(distance, target, method="higher"))
    return model


_NEAR = [[np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= r) for v in range(256)] for r in range(9)]


def substring_radii(radius: int, parts: int = SUBSTRINGS) -> list[int]:
    """Per-substring radii that by the pigeonhole principle miss no code within ``radius``: with radius = a * parts + b,
    radius a in b + 1 substrings and a - 1 in the others (-1: not probed)."""
    a, b = divmod(radius, parts)
    return [min(a, 8) if j <= b else min(a - 1, 8) for j in range(parts)]


class MultiIndex:
    """Substring tables over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8).reshape(-1, SUBSTRINGS)
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(SUBSTRINGS)]
        self.begin = [np.searchsorted(parts[self.order[j], j], np.arange(257)) for j in range(SUBSTRINGS)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius``."""
        hit = np.zeros(len(self.codes), dtype=bool)
        own = np.array([code]).view(np.uint8)
        for j, r in enumerate(substring_radii(radius)):
            if r < 0:
                continue
            begin, values = self.begin[j], _NEAR[r][own[j]]
            lo, n = begin[values], begin[values + 1] - begin[values]
            total = int(n.sum())
            if total:
                hit[self.order[j][np.arange(total) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]] = True
        at = np.flatnonzero(hit)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def _search(shared, k: int, exhaustive: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model: HashModel = shared.value
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        x, y = _matrix(right["vec"]), _matrix(left["qvec"])
        index = MultiIndex(model.codes(x))
        codes = model.codes(y)
        queries, vectors = left["qv"].to_numpy(), right["vid"].to_numpy()
        out = []
        for i in range(len(y)):
            at = np.arange(len(x)) if exhaustive else index.within(codes[i], model.radius)
            s = x[at] @ y[i]
            if len(at) > k:
                best = np.partition(s, len(s) - k)[len(s) - k]
                keep = s >= best - 1e-9
                at, s = at[keep], s[keep]
            out.append((np.full(len(at), queries[i]), vectors[at], s))
        if not out:
            return empty
        q, v, s = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"q": q, "v": v, "score": s})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), ``id_col``, score (inner product in doubles).

    Rows that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take no part. An
    inner product needs vectors of one length: each length is searched by itself. A query's own row (the same id) is no
    candidate. Ties go to the smaller id. Equal vectors are indexed once, with the k + 1 smallest ids of their rows, of
    which no query can need more; equal queries are searched once. If fewer than k are found within the radius, the
    query is compared with all vectors, so that every query gets k results or all candidates. Rows that repeat an id with
    one vector count once; an id with several vectors is found once, with its best score (though each of them
    takes one of the k + 1 places of a search), and as a query asks with each of them. An empty table gives an empty result. Extra columns are not read, whatever their names.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        ok = (v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
              & F.exists(v, lambda c: c != 0) & F.col(id_col).isNotNull())
        return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))

    base, asked = clean(vectors), clean(queries)
    lengths = [r["d"] for r in asked.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()]
    found = [_nearest(base.where(F.size("vec") == d), asked.where(F.size("vec") == d), d, k, index_block, query_block, sample) for d in lengths]
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if len(found) > 1:
        out = out.groupBy("qid", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("qid").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


def _nearest(base: DataFrame, asked: DataFrame, length: int, k: int, index_block: int, query_block: int, sample: int) -> DataFrame:
    """(qid, id, score): at least the k nearest found of each query among vectors of one length."""
    spark = base.sparkSession
    # One row for each distinct vector, with the smallest k + 1 of its ids.
    key = F.xxhash64("vec")
    rows = base.select(key.alias("h"), "id", "vec").distinct()
    ranked = rows.select("h", "vec", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = Window.partitionBy("h", "vec", "salt").orderBy("id")
    few = ranked.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    grouped = few.groupBy("h", "vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    distinct = written(grouped.select(F.monotonically_increasing_id().alias("vid"), "h", "vec", "ids"), "ann-distinct")
    n = distinct.count()
    fraction = min(1.0, sample / max(1, n))
    taken = distinct.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) < F.lit(fraction * (1 << 30))).select("h", "vec").orderBy("h").limit(2 * sample)
    x = np.array([r["vec"] for r in taken.collect()], dtype=np.float64).reshape(-1, length)
    model = learn(x, k) if len(x) else HashModel(np.zeros(length), np.zeros((length, BITS)), BITS)
    shared = spark.sparkContext.broadcast(model)

    queried = written(asked.select(F.col("id").alias("qid"), F.xxhash64("vec").alias("h"), F.col("vec").alias("qvec")).distinct()
                      .join(distinct.select("h", "vec", "vid"), "h").where("qvec = vec").select("qid", "vid"), "ann-queries")
    one = distinct.join(queried.select("vid").distinct(), "vid", "left_semi").select("vid", "vec")
    blocks = max(LEAST_BLOCKS, -(-n // index_block))
    n_queries = one.count()
    q_blocks = max(1, -(-n_queries // query_block))

    def search(query: DataFrame, exhaustive: bool) -> DataFrame:
        q = query.toDF("qv", "qvec").select("qv", "qvec", F.pmod(F.xxhash64("qv", F.lit(5)), F.lit(q_blocks)).alias("qb"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("ib"))
        v = distinct.select("vid", "vec", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(blocks)).alias("ib"), F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")).alias("qb"))
        found = q.groupBy("ib", "qb").cogroup(v.groupBy("ib", "qb")).applyInPandas(_search(shared, k + 1, exhaustive), "q long, v long, score double")
        return found

    hits = written(search(one, False), "ann-hits")
    ids_of = distinct.select(F.col("vid").alias("v"), "ids")

    def best(found: DataFrame, tag: str) -> DataFrame:
        # k + 1 distinct vectors suffice; ties at the edge are all there.
        w = Window.partitionBy("q").orderBy(F.desc("score"))
        top = found.withColumn("r", F.rank().over(w)).where(F.col("r") <= k + 1)
        wide = top.join(ids_of, "v").select("q", "score", F.explode("ids").alias("id")).groupBy("q", "id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return written(wide.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("q", "score", "id"), tag)

    first = best(hits, "ann-best")
    enough = first.groupBy("q").agg(F.count("*").alias("c")).where(F.col("c") >= k + 1).select(F.col("q").alias("vid"))
    short = written(one.join(enough, "vid", "left_anti"), "ann-short")
    if short.isEmpty():
        answers = first
    else:
        again = best(search(short, True), "ann-again")
        answers = first.join(enough.withColumnRenamed("vid", "q"), "q", "left_semi").unionByName(again)
    # Equal queries share their answers; each leaves out its own row.
    each = queried.join(answers, queried["vid"] == answers["q"]).where("qid != id")
    return each.groupBy("qid", "id").agg(F.max("score").alias("score"))
