"""Toxicity by class-conditional Kneser-Ney models.

Words are sequences of folded bytes (64 symbols), each symbol predicted from the seven before it in the word. The top
order counts expressions by class; all lower orders are Kneser-Ney continuation counts shared by the classes and
gathered over every document, so that an expression rare in one class falls back to how the whole corpus spells.
Because the backoff is shared, the difference of the class log-likelihoods of a symbol depends on its eight-gram alone
and sits in one table, whole however large: the most frequent grams are broadcast as a hash table, others joined by
shuffle.

A toxic text is one of whose words a share comes from the toxic model and the others from the ordinary one, so the
log-likelihood difference of a word that the models differ on by d is log(1 - share + share * exp(d)). A text's score is
the sum over its words, divided by their number, calibrated to a probability on labelled texts that gave no counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import FOLD, SYMBOLS, mixed, segment_sums, text_views, written

CONTEXT = 7
#: Up to so many eight-grams are broadcast. Beyond, the most frequent ones are, with their final differences, and the
#: grams of a text that are not among them are joined with the whole table by shuffle.
MAX_BROADCAST_GRAMS = 1_200_000
#: The shares of toxic words among which calibration chooses, and the difference of a word at which it is cut off.
SHARES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)
MOST = 25.0
PREDICT_AT = 0.7


class HashTable:
    """An open-addressing table from non-negative integers to 32-bit floats, built and read by vector operations."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> np.uint64(8)).view(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); values are 0 where a key is missing."""
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), dtype=bool)
        at, slot, k = np.arange(len(keys)), self._slot(keys), keys
        while len(at):
            there = self.keys[slot]
            hit = there == k
            out[at[hit]] = self.values[slot[hit]]
            found[at[hit]] = True
            on = ~hit & (there >= 0)
            at, slot, k = at[on], (slot[on] + 1) & self.mask, k[on]
        return out, found


@dataclass
class ToxicityModel:
    seen: HashTable  # gram -> log P(symbol | context, toxic) - log P(symbol | context, ordinary)
    unseen: HashTable  # context -> the same for symbols that neither class has seen there
    shares: tuple[float, ...]  # one once calibrated
    intercept: float
    slope: float
    tables: tuple[DataFrame, DataFrame] | None = None  # (g, n, diff) and (c, diff) where ``seen`` holds the most frequent grams only


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight-grams of all word symbols of the texts, their word's index, and the first word of each text.

    White space is symbol 0; contexts before a word's beginning are 0 too. ``Words`` has the same grams in fewer rows and is
    held against this.
    """
    n = len(raw)
    symbols = FOLD[raw].astype(np.int64)
    begins = np.zeros(n, dtype=bool)
    inside = symbols > 0
    begins[1:] = inside[1:] & ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < n]
    begins[edges] |= inside[edges]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    word = np.searchsorted(starts, at, side="right") - 1
    depth = at - starts[word]
    g = np.zeros(len(at), np.int64)
    padded = np.concatenate([np.zeros(CONTEXT, np.int64), symbols])
    for j in range(CONTEXT, -1, -1):
        g = g * SYMBOLS + np.where(depth >= j, padded[at - j + CONTEXT], 0)
    return g, word, np.searchsorted(starts, offsets)


ORDER = CONTEXT + 1
_WITHIN = np.array([SYMBOLS**k - 1 for k in range(ORDER + 1)], np.int64)


@dataclass
class Words:
    """The words of some texts. A word's head is its gram at its eighth symbol, or at its last if it is shorter: it tells all
    grams up to there, so that these are counted and looked up once for each distinct head. Later grams are the tail."""
    heads: np.ndarray  # by word
    firsts: np.ndarray  # the first word of each text, and the number of words
    tail: np.ndarray  # grams from the ninth symbols on, by word and place
    tail_word: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(raw)
    symbols = np.zeros(n + ORDER, np.uint8)
    symbols[ORDER:] = FOLD[raw]
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = symbols[ORDER:] > 0
    begins = inside[1:] & ~inside[:-1]
    edges = offsets[:-1]
    begins[edges] = inside[edges + 1]
    starts = np.flatnonzero(begins[:n])
    ends = np.flatnonzero(inside[1:-1] & (begins[1:] | ~inside[2:]))
    two = symbols[:-1].astype(np.uint16) << 6 | symbols[1:]
    four = two[:-2].astype(np.uint32) << 12 | two[2:]
    gram = lambda at: four[at + 1].astype(np.int64) << 24 | four[at + 5]
    length = np.minimum(ends - starts + 1, ORDER)
    heads = gram(starts + length - 1) & _WITHIN[length]
    tails = ends - starts + 1 - length
    long = np.flatnonzero(tails)
    tails = tails[long]
    tail_word = np.repeat(long, tails)
    places = np.arange(len(tail_word)) + np.repeat(starts[long] + ORDER - (np.cumsum(tails) - tails), tails)
    return Words(heads, np.searchsorted(starts, offsets), gram(places), tail_word)


def head_grams(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of heads, the shortest first, and the index of each one's head; by head."""
    length = np.searchsorted(_WITHIN, heads)
    of = np.repeat(np.arange(len(heads)), length)
    later = np.repeat(np.cumsum(length), length) - 1 - np.arange(len(of))
    return heads[of] >> (6 * later), of


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def _count():
    schema = pa.schema([("kind", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def flush(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            keys, counts = flush(kept)
            kind, gram = (keys >> 48).astype(np.int32), keys & ((1 << 48) - 1)
            for lo in range(0, len(keys), 100_000):
                yield pa.record_batch([pa.array(x[lo:lo + 100_000]) for x in (kind, gram, counts)], schema=schema)

        for batch in batches:
            for first, last, raw, offsets in text_views(batch.column(0), 2 << 20):
                kind = batch.column(1).slice(first, last - first).to_numpy(zero_copy_only=False).astype(np.int64)
                words = words_of(raw, offsets)
                kinds = np.repeat(kind << 48, np.diff(words.firsts))
                heads, times = np.unique(words.heads | kinds, return_counts=True)
                g, of = head_grams(heads & _WITHIN[ORDER])
                tail, tail_times = np.unique(words.tail | kinds[words.tail_word], return_counts=True)
                kept.append(summed(np.concatenate([g | (heads[of] & ~_WITHIN[ORDER]), tail]), np.concatenate([times[of], tail_times])))
                size += len(kept[-1][0])
                if size > 1_200_000:
                    kept[:] = [flush(kept)]
                    size = len(kept[0][0])
                    if size > 800_000:  # a task's table stays bounded: what it has goes to the shuffle
                        yield from emit()
                        kept.clear()
                        size = 0
        yield from emit()
    return run


def gram_counts(texts: DataFrame, text: Column, kind: Column) -> DataFrame:
    """(kind, gram, n) over all rows; ``kind`` is 0 unlabelled, 1 ordinary, 2 toxic."""
    src = texts.select(F.coalesce(text, F.lit("")).alias("t"), kind.cast("int").alias("k"))
    counted = src.mapInArrow(_count(), "kind int, gram long, n long")
    return counted.groupBy("gram").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1, 2)])


def most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the highest ``n``, by whole levels of log2 n, ``most`` at the most."""
    level = F.least(F.ceil(F.log2(F.col("n").cast("double"))), F.lit(40)).cast("int")
    kept, least = 0, 41
    for lv, n in sorted(((r["lv"], r["count"]) for r in rows.groupBy(level.alias("lv")).count().collect()), reverse=True):
        if kept + n > most:
            break
        kept, least = kept + n, lv
    return rows.where(level >= least)


def shared_probabilities(counts: DataFrame) -> DataFrame:
    """(s, p): the Kneser-Ney probability of the last symbol of each seven-gram of ``counts`` after the six before it.

    Aggregates over distinct left extensions, order by order. No group has more than 64 rows: the left extensions of
    a gram, or the symbols after a context.
    """
    levels: dict[int, DataFrame] = {}
    level, col = counts, "gram"
    for k in range(CONTEXT, 0, -1):
        level = written(level.groupBy(F.col(col).bitwiseAND(SYMBOLS**k - 1).alias("s")).agg(F.count("*").cast("double").alias("kinds")), f"toxic-order{k}")
        levels[k], col = level, "s"
    lower = None
    for k in range(1, CONTEXT + 1):
        d, after = _discount_of(levels[k], "kinds"), Window.partitionBy(F.shiftright("s", 6))
        t = levels[k].select("s", "kinds", F.sum("kinds").over(after).alias("total"), F.count("*").over(after).alias("types"))
        if lower is None:
            t = t.withColumn("base", F.lit(1.0 / SYMBOLS))
        else:
            t = t.withColumn("_l", F.col("s").bitwiseAND(SYMBOLS ** (k - 1) - 1)).join(lower.toDF("_l", "base"), "_l")
        lower = t.select("s", (F.greatest(F.col("kinds") - d, F.lit(0.0)) / F.col("total") + F.lit(d) * F.col("types") / F.col("total") * F.col("base")).alias("p"))
    return lower


def train_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``counts`` (gram, n0, n1, n2): (g, n, diff) of all grams seen in labelled texts, and (c, diff) of their contexts.

    The tables that ``train`` makes of arrays, as DataFrames; nothing is left out, whatever their size.
    """
    known = counts.where("n1 + n2 > 0")
    at, after = known.withColumn("s", F.col("gram").bitwiseAND(SYMBOLS**CONTEXT - 1)), Window.partitionBy("c")
    t = at.join(shared_probabilities(counts), "s").withColumn("c", F.shiftright("gram", 6))
    p, weight = {}, {}
    for n in ("n1", "n2"):
        d = _discount_of(known, n)
        t = t.withColumns({f"t{n}": F.sum(n).over(after), f"k{n}": F.sum((F.col(n) > 0).cast("int")).over(after)})
        weight[n] = F.when(F.col(f"t{n}") > 0, F.lit(d) * F.col(f"k{n}") / F.col(f"t{n}")).otherwise(F.lit(1.0))
        p[n] = F.greatest(F.col(n) - F.lit(d), F.lit(0.0)) / F.greatest(F.col(f"t{n}"), F.lit(1)) + weight[n] * F.col("p")
    ratio = lambda x: (F.log(F.greatest(x["n2"], F.lit(1e-12))) - F.log(F.greatest(x["n1"], F.lit(1e-12)))).cast("float")
    t = written(t.select(F.col("gram").alias("g"), (F.col("n0") + F.col("n1") + F.col("n2")).alias("n"), "c", ratio(p).alias("diff"), ratio(weight).alias("other")), "toxic-model")
    return t.select("g", "n", "diff"), t.groupBy("c").agg(F.first("other").alias("diff"))


def _discount_of(rows: DataFrame, n: str) -> float:
    one, two = rows.agg(F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)).first()
    return one / (one + 2 * two) if one and two else 0.75


def _hash_table(rows: DataFrame) -> HashTable:
    got = rows.toArrow()
    return HashTable(got.column(0).to_numpy(), got.column(1).to_numpy())


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, values, len(unique)), np.bincount(inverse, minlength=len(unique)).astype(float)


def _discount(counts: np.ndarray) -> float:
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.75


def train(gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> tuple[HashTable, HashTable]:
    """The two tables of ToxicityModel from arrays of all grams and their counts by class: what ``train_tables`` is held against."""
    order = np.argsort(gram)
    gram, ordinary, toxic = gram[order], ordinary[order], toxic[order]
    del order
    # Shared lower orders: distinct left extensions, then interpolated down to the uniform distribution.
    shared: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    level, lower = gram, None
    for k in range(CONTEXT, 0, -1):
        level, kinds = np.unique(level % SYMBOLS**k, return_counts=True)
        shared[k] = (level, kinds.astype(float))
    for k in range(1, CONTEXT + 1):
        keys, kinds = shared.pop(k)
        ctx, total, types = _groups(keys // SYMBOLS, kinds)
        d = _discount(kinds)
        at = np.searchsorted(ctx, keys // SYMBOLS)
        if lower is None:
            base = np.full(len(keys), 1.0 / SYMBOLS)
        else:
            base = lower[1][np.searchsorted(lower[0], keys % SYMBOLS ** (k - 1))]
        lower = (keys, np.maximum(kinds - d, 0) / total[at] + d * types[at] / total[at] * base)
    backoff = lower[1][np.searchsorted(lower[0], gram % SYMBOLS**CONTEXT)] if len(gram) else np.zeros(0)

    known = (ordinary + toxic) > 0
    contexts, at = np.unique(gram[known] // SYMBOLS, return_inverse=True)
    g, shared_p = gram[known], backoff[known]
    logs = []
    for counts in (toxic[known], ordinary[known]):
        total = np.bincount(at, counts, len(contexts))
        types = np.bincount(at, counts > 0, len(contexts))
        d = _discount(counts)
        weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        p = np.maximum(counts - d, 0) / np.maximum(total[at], 1) + weight[at] * shared_p
        logs.append((np.log(np.maximum(p, 1e-12)), np.log(weight)))
    # For symbols that neither class has seen in a context the shared backoff cancels; the weights remain.
    return HashTable(g, logs[0][0] - logs[1][0]), HashTable(contexts, logs[0][1] - logs[1][1])


def weighed(words: np.ndarray, share: float) -> np.ndarray:
    """The log-likelihood difference of words between a toxic text with a share of toxic words and an ordinary one."""
    return np.log1p(share * np.expm1(np.minimum(words, MOST)))


def _weighed(words: Column, share: float) -> Column:
    return F.log1p(F.lit(share) * F.expm1(F.least(words, F.lit(MOST))))


def differences(model: ToxicityModel, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By text and share: the length-normalised difference, the mean over the words (0 without words)."""
    out = np.zeros((len(offsets) - 1, len(model.shares)))
    words = words_of(raw, offsets)
    firsts = words.firsts
    if not firsts[-1]:
        return out

    def value_of(g: np.ndarray) -> np.ndarray:
        value, found = model.seen.get(g)
        value[~found] = model.unseen.get(g[~found] // SYMBOLS)[0]
        return value

    heads, head = np.unique(words.heads, return_inverse=True)
    g, of = head_grams(heads)
    words = np.bincount(of, value_of(g), len(heads))[head] + np.bincount(words.tail_word, value_of(words.tail), firsts[-1])
    for j, share in enumerate(model.shares):
        out[:, j] = segment_sums(weighed(words, share), firsts[:-1], firsts[1:]) / np.maximum(np.diff(firsts), 1)
    return out


def _doubles(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, last, raw, offsets in text_views(batch.column(1), 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), _doubles(differences(model, raw, offsets))], names=["id", "f"])
    return run


def _open_words(shared):
    """A row by text with the sums of the words that the broadcast grams decide, then a row by gram that they lack.

    The first open gram of a word brings along what its other grams add up to.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, last, raw, offsets in text_views(batch.column(2), 2 << 20):
                rows, n = batch.column(1).slice(first, last - first), last - first
                of_texts = words_of(raw, offsets)
                firsts, tail_word = of_texts.firsts, of_texts.tail_word
                heads, head = np.unique(of_texts.heads, return_inverse=True)
                g, of = head_grams(heads)
                value, found = model.seen.get(g)
                tail_value, tail_found = model.seen.get(of_texts.tail)
                words = np.bincount(of, value, len(heads))[head] + np.bincount(tail_word, tail_value, firsts[-1])
                # The open grams of each word: those of its head, then those of its tail.
                g, many = g[~found], np.bincount(of[~found], minlength=len(heads))
                by_word = many[head]
                word = np.repeat(np.arange(firsts[-1]), by_word)
                g = g[np.arange(len(word)) + np.repeat((np.cumsum(many) - many)[head] - (np.cumsum(by_word) - by_word), by_word)]
                word, g = np.concatenate([word, tail_word[~tail_found]]), np.concatenate([g, of_texts.tail[~tail_found]])
                at = np.argsort(word, kind="stable")
                word, g = word[at], g[at]
                is_open = np.zeros(firsts[-1], bool)
                is_open[word] = True
                text = np.repeat(np.arange(n), np.diff(firsts))
                sums = np.stack([np.bincount(text, np.where(is_open, 0.0, weighed(words, share)), n) for share in model.shares], axis=1)
                nulls = lambda kind, m: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), rows, nulls(pa.int64(), n), nulls(pa.int64(), n), nulls(pa.float64(), n),
                                                  pa.array(np.diff(firsts).astype(np.int64)), _doubles(sums)], names=OPEN)
                number, ids, kind = rows.to_numpy(), word - firsts[text[word]], batch.column(0).type
                part = np.where(np.diff(word, prepend=-1) != 0, words[word], 0.0)
                for lo in range(0, len(word), 100_000):
                    cut = slice(lo, lo + 100_000)
                    m = len(word[cut])
                    yield pa.RecordBatch.from_arrays([nulls(kind, m), pa.array(number[text[word[cut]]]), pa.array(g[cut]), pa.array(ids[cut].astype(np.int64)), pa.array(part[cut]),
                                                      nulls(pa.int64(), m), nulls(pa.list_(pa.float64()), m)], names=OPEN)
    return run


OPEN = ["id", "row", "g", "word", "part", "words", "sums"]


def document_differences(src: DataFrame, model: ToxicityModel) -> DataFrame:
    """(id, f) by row of ``src`` (id, t); grams that are not broadcast are joined with the whole tables by shuffle."""
    shared = src.sparkSession.sparkContext.broadcast(replace(model, tables=None))
    id_type = src.schema["id"].dataType.simpleString()
    if model.tables is None:
        return src.mapInArrow(_apply(shared), f"id {id_type}, f array<double>")
    numbered = src.select("id", F.monotonically_increasing_id().alias("row"), "t")
    rows = written(numbered.mapInArrow(_open_words(shared), f"id {id_type}, row long, g long, word long, part double, words long, sums array<double>"), "toxic-open")
    seen, unseen = model.tables
    opened = rows.where("g IS NOT NULL").select("row", "word", "part", "g", F.shiftright("g", 6).alias("c"))
    opened = opened.join(seen.select("g", F.col("diff").alias("d")), "g", "left").join(unseen.withColumnRenamed("diff", "other"), "c", "left")
    value = F.sum(F.col("part") + F.coalesce("d", "other", F.lit(0.0)))
    words = opened.groupBy("row", "word").agg(value.alias("v"))
    late = words.groupBy("row").agg(*[F.sum(_weighed(F.col("v"), share)).alias(f"s{j}") for j, share in enumerate(model.shares)])
    both = rows.where("g IS NULL").join(late, "row", "left")
    f = [(F.col("sums")[j] + F.coalesce(f"s{j}", F.lit(0.0))) / F.greatest("words", F.lit(1)) for j in range(len(model.shares))]
    return both.select("id", F.array(*f).alias("f"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """(intercept, slope, log-loss) of a logistic regression in one variable, by Newton's method on the standardised variable."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones(len(x)), (x - mean) / scale], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


#: At most about so many labelled texts calibrate the score.
CALIBRATION_TEXTS = 20_000


def fit(docs: DataFrame, label: Column, calibrate: Column, id_col: str = "doc_id", text_col: str = "text",
        max_broadcast: int = MAX_BROADCAST_GRAMS) -> ToxicityModel:
    """A model from ``docs``: ``label`` 0, 1 or null (unlabelled); ``calibrate`` marks the labelled rows kept from counting.

    All rows give shared counts, all labelled rows outside ``calibrate`` class counts. Without labels of both classes
    the scores are the share of toxic labels, or 0 without any. Ids may be null or repeat; an empty table gives a model
    that scores 0.
    """
    kind = F.when(label.isNull() | F.coalesce(calibrate, F.lit(False)), 0).otherwise(label.cast("int") + 1)
    counts = written(gram_counts(docs, F.col(text_col), kind), "toxic-counts")
    seen, unseen = train_tables(counts)
    whole = seen.count() <= max_broadcast
    if whole:
        tables, frequent, other = None, seen.select("g", "diff"), unseen
    else:
        unseen = written(unseen, "toxic-contexts")
        n = F.col("n0") + F.col("n1") + F.col("n2")
        top = most_frequent(counts.select(F.col("gram").alias("g"), n.alias("n")), max_broadcast).withColumn("c", F.shiftright("g", 6))
        top = top.join(seen.select("g", F.col("diff").alias("d")), "g", "left").join(unseen.withColumnRenamed("diff", "other"), "c", "left")
        tables, frequent, other = (seen, unseen), top.select("g", F.coalesce("d", "other", F.lit(0.0).cast("float"))), unseen.where("false")
    model = ToxicityModel(_hash_table(frequent), _hash_table(other), SHARES, 0.0, 0.0, tables)
    held = docs.where(calibrate & label.isNotNull()).select(label.cast("int").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.xxhash64(id_col, F.lit(4)).alias("h"))
    n = held.count()
    if n > CALIBRATION_TEXTS:
        held = held.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * CALIBRATION_TEXTS / n)))
    got = document_differences(held.select("id", "t"), model).toArrow()
    y = got.column(0).to_numpy().astype(float)
    x = np.array(got.column(1).to_pylist(), dtype=float).reshape(len(y), len(SHARES))
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-18
        return replace(model, shares=SHARES[:1], intercept=float(np.log(share / (1 - share))))
    lines = [(*logistic(x[:, j], y), share) for j, share in enumerate(SHARES)]
    intercept, slope, _, share = min(lines, key=lambda v: v[2])
    return replace(model, shares=(share,), intercept=intercept, slope=slope)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, score in 0 to 1, predicted (1 from PREDICT_AT on).

    Null texts count as empty; a text without words has difference 0 and the score that goes with it. Whole texts are
    scored, however long. Repeated rows are scored each, null ids too; extra columns are not read, whatever their names;
    an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    z = F.lit(model.intercept) + F.lit(model.slope) * F.col("f")[0]
    out = document_differences(src, model).select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int")).withColumnRenamed("id", id_col)
