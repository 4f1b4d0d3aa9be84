"""Near-duplicate detection with BagMinHash signatures.

A text is the multiset of its five-word shingles. Weights (counts) are discretised at the integers and covered by
dyadic layers [0,1), [1,2), [2,4), [4,8), ...; each layer of each shingle carries a Poisson process whose points
come in ascending order, each with a signature component and, by successive halving of its layer, a unit of weight.
A point counts if its unit lies below the shingle's weight, and a component keeps its earliest point. Two texts
agree in a component with the probability of their weighted Jaccard similarity. A shingle's process is followed
only until it passes the largest component value, so that most shingles cost one point.

Bands of the signature name buckets of candidates; texts are verified on their whole multisets. Verification works on
blocks of bounded size: a block's overlaps are one product of incidence matrices, and of the links found only those
leave it that join components. Members first meet in blocks around the smallest text of their bucket. Where a bucket
still spans several components, all its members outside its largest component then meet the whole bucket, block by
block, so that no candidate pair between components goes unverified, without a join that makes a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import mixed, row_hash, seeded, text_views, without_rows, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A block of verification holds about so many texts and shingles of a side (a single longer text is on its own).
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 500_000
#: 20 bands of 5 components: a pair at similarity 0.8 shares a band with probability 0.9996.
BANDS, ROWS = 20, 5

_U = np.uint64
_BYTE = seeded(256, 11)
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(inverse), np.uint64)]), dtype=np.uint64)
    return up, down


#: Bytes hashed at a time; longer texts are taken in pieces that end between words.
PIECE = 1 << 20
_POWERS = _powers(PIECE)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space) in the texts, and each text's first word."""
    out, firsts, words = [], [0], 0
    n = len(offsets) - 1
    text = 0
    while text < n:
        # As many whole texts as fit a piece, or the pieces of one long text.
        last = max(text + 1, int(np.searchsorted(offsets, offsets[text] + PIECE, side="right")) - 1)
        last = min(last, n)
        lo, hi = int(offsets[text]), int(offsets[last])
        if hi - lo <= PIECE:
            h, first = _piece_hashes(raw[lo:hi], offsets[text:last + 1] - lo)
            out.append(h)
            firsts += [words + int(f) for f in first[1:]]
            words += len(h)
        else:
            while lo < hi:
                end = min(hi, lo + PIECE)
                if end < hi:
                    gaps = np.flatnonzero(_SPACE[raw[lo:end]])
                    end = lo + int(gaps[-1]) + 1 if len(gaps) else lo + _long_word(raw, lo, hi)
                h, _ = _piece_hashes(raw[lo:end], np.array([0, end - lo]))
                out.append(h)
                words += len(h)
                lo = end
            firsts.append(words)
        text = last
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(firsts, np.int64)


def _long_word(raw: np.ndarray, lo: int, hi: int) -> int:
    """Length of the word at ``lo``, which is longer than a piece."""
    for at in range(lo, hi, PIECE):
        gaps = np.flatnonzero(_SPACE[raw[at:min(hi, at + PIECE)]])
        if len(gaps):
            return at + int(gaps[0]) + 1 - lo
    return hi - lo


def _piece_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _POWERS if n < len(_POWERS[0]) else _powers(n)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < n]
    begins[borders] = inside[borders]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:n] = inside[:-1] & ~inside[1:]
    ends[n] = inside[-1]
    inner = borders[borders > 0]
    ends[inner] |= inside[inner - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], dtype=np.uint64, out=prefix[1:])
        h = mixed((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64) * _GOLDEN)
    return h, np.searchsorted(s, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order, and each text's first shingle (one more than texts).

    A text of fewer than ``words`` words is one shingle; a text without words has none.
    """
    h, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    each = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    starts = np.concatenate([[0], np.cumsum(each)])
    text = np.repeat(np.arange(len(counts)), each)
    at = np.arange(starts[-1]) - starts[text] + first[text]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(words):
            here = np.where(k < counts[text], padded[at + k], _U(k))
            out = mixed(out * _BASE + here)
    return out, starts


def multisets(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of the texts' multisets, sorted by text and element."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(t)))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int, block: int = 1 << 18) -> np.ndarray:
    """BagMinHash signatures: for each of ``n`` texts, the ids of the earliest points in ``m`` components.

    Elements are followed ``block`` at a time, so that a very long text takes no more memory than many short ones.
    """
    best = np.full(n * m, np.inf)
    ident = np.zeros(n * m, dtype=np.uint64)
    for lo in range(0, len(text), block):
        _follow(text[lo:lo + block], element[lo:lo + block], weight[lo:lo + block], n, m, best, ident)
    return ident.reshape(n, m)


def _follow(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int, best: np.ndarray, ident: np.ndarray) -> None:
    layers = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    unit = np.repeat(np.arange(len(text)), layers)
    layer = np.arange(len(unit)) - np.repeat(np.cumsum(layers) - layers, layers)
    t, w = text[unit], weight[unit]
    low = np.where(layer == 0, 0, 1 << np.maximum(layer - 1, 0))
    width = np.where(layer == 0, 1, low)
    with np.errstate(over="ignore"):
        seed = mixed(element[unit] + (layer.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))
    arrival = np.zeros(len(unit))
    active = np.arange(len(unit))
    step = 0
    while len(active):
        step += 1
        with np.errstate(over="ignore"):
            r1 = mixed(seed[active] + _U(2 * step) * _GOLDEN)
            r2 = mixed(seed[active] + _U(2 * step + 1) * _GOLDEN)
        gap = -np.log1p(-(r1 >> _U(11)).astype(np.float64) * 2.0**-53)
        arrival[active] += gap / (m * width[active])
        x = arrival[active]
        component = ((r2 >> _U(32)) % _U(m)).astype(np.int64)
        # Successive halving of a layer by the bits of r2 names the unit of weight.
        weight_unit = low[active] + ((r2 & _U(0xFFFFFFFF)).astype(np.int64) & (width[active] - 1))
        slot = t[active] * m + component
        counts = np.flatnonzero((weight_unit < w[active]) & (x < best[slot]))
        if len(counts):
            order = counts[np.lexsort((x[counts], slot[counts]))]
            first = np.ones(len(order), dtype=bool)
            first[1:] = slot[order[1:]] != slot[order[:-1]]
            win = order[first]
            best[slot[win]] = x[win]
            ident[slot[win]] = mixed(r1[win] ^ (r2[win] >> _U(1)))
        bound = best.reshape(n, m).max(axis=1)
        active = active[x < bound[t[active]]]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets of hashes."""
    if not len(a) or not len(b):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


def _fingerprints(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums by text; equal multisets have equal ones, in whatever order their shingles come."""
    with np.errstate(over="ignore"):
        parts = mixed(element * weight.astype(np.uint64) + weight.astype(np.uint64) * _GOLDEN)
        sums = np.zeros((2, n), np.uint64)
        np.add.at(sums[0], text, parts)
        np.add.at(sums[1], text, mixed(parts + _U(77)))
    return sums.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _sign(bands: int, rows: int):
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in text_views(batch.column(2), 1 << 20):
                h, starts = shingles(raw, offsets)
                text, element, weight = multisets(h, starts)
                n = last - first
                sig = signatures(text, element, weight, n, bands * rows)
                key = np.zeros((n, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        key = mixed(key * _BASE + sig[:, k::rows])
                fp, fp2 = _fingerprints(text, element, weight, n)
                yield pa.record_batch([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(fp), pa.array(fp2),
                                       pa.array(np.diff(starts)), _lists(key.view(np.int64).ravel(), np.arange(0, n * bands + 1, bands))], schema=schema)
    return run


def _bag():
    """Texts as sorted sets of 64-bit hashes, one for each occurrence of each shingle."""
    schema = pa.schema([("fp", pa.int64()), ("fp2", pa.int64()), ("bag", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in text_views(batch.column(0), 1 << 20):
                h, starts = shingles(raw, offsets)
                text, element, weight = multisets(h, starts)
                fp, fp2 = _fingerprints(text, element, weight, last - first)
                yield pa.record_batch([pa.array(fp), pa.array(fp2), _lists(occurrences(element, weight).view(np.int64), starts)], schema=schema)
    return run


def occurrences(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight, so that a multiset's weighted overlaps are those of a set."""
    rank = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return mixed(np.repeat(element, weight) + rank.astype(np.uint64) * _GOLDEN)


def similarities(bags: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of ``bags`` (sets of occurrence hashes), by products of incidence
    matrices of ``columns`` hashes each. Hashes that only one bag has cannot overlap and take no column."""
    m, sizes = len(bags), np.array([len(b) for b in bags], dtype=np.float64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, at, counts = np.unique(np.concatenate(bags) if m else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    owner, at = owner[shared], (np.cumsum(counts > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((m, m))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, (lo, lo + columns))
        part = np.zeros((m, min(columns, int(at[-1]) + 1 - lo)), np.float32)
        part[owner[a:b], at[a:b] - lo] = 1
        common += part @ part.T
    return common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1)


def joining_links(similar: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that connect all labels which ``similar`` (a square of booleans) connects, one less than those."""
    linked = similar | (label[:, None] == label[None, :])
    root = np.arange(len(label))
    while True:
        low = np.where(linked, root[None, :], len(label)).min(axis=1, initial=len(label))
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    pairs = np.unique(np.stack([label, label[root]], axis=1)[label != label[root]], axis=0).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _link_blocks(threshold: float):
    """Joining links within each run of rows of equal ``block``; rows come sorted by it, and a block is all a task holds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch | None:
        label = np.concatenate([x.to_numpy() for x, _ in rows])
        if len(label) < 2 or (label == label[0]).all():
            return None
        bags = [v for _, x in rows for v in np.split(x.flatten().to_numpy(), np.cumsum(pc.list_value_length(x).to_numpy()))[:-1]]
        a, b = joining_links(similarities(bags) >= threshold, label)
        return pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[pa.Array, pa.Array]] = []
        at = None
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if rows and block[lo] != at and (found := links(rows)) is not None:
                    yield found
                if block[lo] != at:
                    rows = []
                at = block[lo]
                rows.append((batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)))
        if rows and (found := links(rows)) is not None:
            yield found
    return run


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, by alternating large-star and small-star steps."""
    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    if pairs.isEmpty():
        return nodes.select("node", F.col("node").alias("label"))
    last = None
    while True:  # the steps settle after a number of rounds logarithmic in the longest path, squared at most
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        pairs = written(small, "stars")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("label"))


#: Up to so many ids (16 bytes each) are broadcast to fetch the members' texts; beyond, both sides are shuffled.
MAX_BROADCAST_IDS = 2_000_000


def _chunks(n: str, size: str):
    """How many blocks ``n`` texts with ``size`` shingles in all are dealt over."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("long")


def _representatives(src: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(signed, classes) of ``src`` (id, hash, text): a row by row with id, hash, fp, fp2 and size, and a row by distinct
    multiset with fp, fp2, label, n (its rows) and first (null id, id and hash of its first row)."""
    signed = written(src.mapInArrow(_sign(bands, rows), "id long, hash long, fp long, fp2 long, size long, bands array<long>"), "bag-signatures")
    found = signed.where("size > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    reps = found.groupBy("fp", "fp2").agg(first, F.first("bands").alias("bands"), F.first("size").alias("size"), F.count("*").alias("n"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "bag-reps")

    buckets = reps.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("count")).where("count > 1").drop("count")
    members = written(buckets.join(shared, ["band", "key"]), "bag-members")

    # The members' multisets, read once more from the texts and matched by fingerprint.
    wanted = reps.join(members.select("node").distinct(), "node", "left_semi").select("fp", "fp2", "node", F.col("first.id").alias("id"))
    ids = written(wanted.select(F.col("id").alias("wanted")).distinct(), "bag-ids")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    bags = src.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text").mapInArrow(_bag(), "fp long, fp2 long, bag array<long>")
    bags = written(bags.join(wanted.select("fp", "fp2", "node"), ["fp", "fp2"]).groupBy("node").agg(F.first("bag").alias("bag")), "bag-sets")

    def linked(blocks: DataFrame, tag: str) -> DataFrame:
        """Joining links of ``blocks`` (block, label, node); blocks are named by hash, and if two share one nothing is lost."""
        rows_ = blocks.join(bags, "node").select("block", "label", "bag").repartition("block").sortWithinPartitions("block")
        return written(rows_.mapInArrow(_link_blocks(threshold), "a long, b long"), tag)

    # The members of a bucket around its hub: as many rows as members, and the hub once a block.
    stars = members.where("node != hub").select("hub", "node", "size").distinct()
    dealt = stars.groupBy("hub").agg(F.count("*").alias("members"), F.sum("size").alias("total")).select("hub", _chunks("members", "total").alias("chunks"))
    dealt = written(dealt, "bag-hubs")
    around = stars.join(dealt, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("block"), "node")
    hubs = dealt.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).select(F.xxhash64("hub", "chunk").alias("block"), F.col("hub").alias("node"))
    links = linked(around.unionByName(hubs).withColumn("label", F.col("node")), "bag-stars")
    labels = written(_components(reps.select("node"), links), "bag-labels")

    # Buckets that still span several components: who is outside the largest one meets all.
    tagged = written(members.join(labels, "node").select("band", "key", "node", "size", "label"), "bag-tagged")
    parts = tagged.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    largest = F.max(F.struct("n", "label", "s"))
    mixed_ = parts.groupBy("band", "key").agg(largest.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels")).where("labels > 1 AND n > 2")
    mixed_ = mixed_.select("band", "key", F.col("top.label").alias("largest"), F.col("top.n").alias("n_in"), F.col("top.s").alias("s_in"),
                           (F.col("n") - F.col("top.n")).alias("n_out"), (F.col("s") - F.col("top.s")).alias("s_out"))
    mixed_ = written(mixed_.select("band", "key", "largest", _chunks("n_in", "s_in").alias("inner"), _chunks("n_out", "s_out").alias("outer")), "bag-mixed")
    met = tagged.join(mixed_, ["band", "key"])
    own = lambda k: F.pmod(F.xxhash64("node", F.lit(3)), F.col(k))
    to = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    inside = F.transform(to("outer"), lambda i: F.xxhash64("band", "key", F.lit("in"), i, own("inner")))
    outside = F.concat(F.transform(to("inner"), lambda j: F.xxhash64("band", "key", F.lit("in"), own("outer"), j)),
                       F.transform(to("outer"), lambda k: F.xxhash64("band", "key", F.lit("out"), F.least(own("outer"), k), F.greatest(own("outer"), k))))
    outside = F.when((F.col("inner") == 1) & (F.col("outer") == 1), inside).otherwise(outside)  # they meet there already
    blocks = met.select(F.explode(F.when(F.col("label") == F.col("largest"), inside).otherwise(outside)).alias("block"), "label", "node")
    more = linked(blocks, "bag-rest")
    roots = written(_components(labels.select(F.col("label").alias("node")).distinct(), more), "bag-roots").toDF("label", "root")
    final = labels.join(roots, "label").select("node", F.col("root").alias("label"))
    return signed, written(reps.select("node", "fp", "fp2", "n", "first").join(final, "node").drop("node"), "bag-classed")


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> DataFrame:
    """(id, hash, class_id, class_size, keep) by row; ``keep`` is the (none, id, hash) of the row that stands for the class."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(F.col(text_col)).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed, reps = _representatives(src, threshold, bands, rows)
    classes = reps.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("first").alias("keep"), F.count("*").alias("reps")).where("reps > 1").drop("reps")
    classes = written(classes, "bag-classes")
    told = reps.join(classes, "label", "left").select("fp", "fp2", F.coalesce("class_size", "n").alias("class_size"), F.coalesce("keep", "first").alias("keep"))
    told = written(told, "bag-told")
    classed = signed.where("size > 0").select("id", "hash", "fp", "fp2").join(told, ["fp", "fp2"]).select("id", "hash", F.col("keep.id").alias("class_id"), "class_size", "keep")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    alone = signed.where("size = 0").select("id", "hash", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), own.alias("keep"))
    return classed.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``id_col``, class_id, class_size (rows in the class).

    Texts are linked if the weighted Jaccard similarity of their multisets of five-word shingles is ``threshold`` or
    more; a class is a connected component of links and its id the smallest id in it (null if all are null). Texts of
    equal multisets share one representative and are not compared again. Words are runs without white space, compared
    exactly. A text of fewer than five words is one shingle. Null, empty and white texts have none: each is a class of
    its own. Rows are told apart by id and text: rows that repeat an id with another text are classed by their own
    text, rows that repeat both are reported as often as they occur. Very long texts are read whole, in pieces. An empty
    table gives an empty result; extra columns are not read, whatever their names.
    """
    return _classed(docs, id_col, text_col, threshold, bands, rows).select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all columns: that of the smallest id (null ids last; ties by
    a hash of the text). Of rows that repeat id and text one stays. Rows without words are classes of their own and stay."""
    rows = written(_classed(docs, id_col, text_col, THRESHOLD, BANDS, ROWS), "bag-rows")
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & F.col("hash").eqNullSafe(F.col("keep.hash"))
    repeated = rows.where(stays & (F.col("class_size") > 1)).groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return without_rows(docs, F.col(id_col), row_hash(F.col(text_col)), rows.where(~stays).select("id", "hash"), repeated)
