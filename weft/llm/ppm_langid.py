"""Language identification by prediction with partial matching (PPM).

Each language has a context tree over bytes, three bytes deep. A byte's probability comes from the longest context that
has seen it; each context passed on the way down charges its escape probability (method C: distinct successors over
occurrences plus distinct successors), and a byte that no context has seen is uniform. After training the statistics are
frozen, so the exact code length of a byte depends on the four bytes up to it alone. Code lengths of the grams that any
language has seen are tabled by order; others charge the order's escapes and go on to the next shorter context. Scoring
looks up every byte of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import segment_sums, text_views

ORDER = 3
#: The bounded training sample: about so many whole texts of each language, chosen by hash.
SAMPLE_TEXTS = 400
#: The score of a longer text is that of its mean code lengths over so many bytes, so that it does not saturate.
EVIDENCE_BYTES = 256
UNDETERMINED = "und"
#: What comes before a text.
_START = 32


@dataclass
class PpmModel:
    languages: list[str]
    symbol: np.ndarray  # (256,) byte -> symbol; bytes that no sample text has share the last symbol
    context: list[np.ndarray]  # by order: context of symbols -> its row, or -1
    entry: list[np.ndarray]  # by order: (row, symbol) -> row of ``bits``, or -1
    bits: list[np.ndarray]  # by order: (entry, language) code length of the symbol
    escape: list[np.ndarray]  # by order: (row, language) bits of the escape; 0 where a language has not seen the context


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ORDER spaces before each text, and the places where the texts begin."""
    n = len(offsets) - 1
    shift = np.repeat(np.arange(1, n + 1), np.diff(offsets)) * ORDER
    out = np.full(len(raw) + ORDER * n, _START, dtype=np.uint8)
    out[np.arange(len(raw)) + shift] = raw
    return out, offsets[:-1] + ORDER * np.arange(1, n + 1)


def gram_counts(raw: np.ndarray, offsets: np.ndarray, block: int = 1 << 18) -> dict[int, int]:
    """Counts of the grams of four bytes that end in each byte of the texts, in blocks whatever a text's length."""
    total: dict[int, int] = {}
    for first in range(len(offsets) - 1):
        text = raw[offsets[first]:offsets[first + 1]]
        for lo in range(0, len(text), block):
            before = text[max(0, lo - ORDER):lo]
            s = np.concatenate([np.full(ORDER - len(before), _START, np.uint8), before, text[lo:lo + block]]).astype(np.int64)
            n = len(s) - ORDER
            grams, counts = np.unique(((s[:n] * 256 + s[1:n + 1]) * 256 + s[2:n + 2]) * 256 + s[3:], return_counts=True)
            for g, k in zip(grams.tolist(), counts.tolist()):
                total[g] = total.get(g, 0) + k
    return total


def train(texts: dict[str, list[str]]) -> PpmModel:
    """Context trees from sample texts by language; a language without text is left out."""
    counts = {}
    for language, some in texts.items():
        raw = [(t or "").encode("utf-8", "replace") for t in some]
        counts[language] = gram_counts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return train_counts(counts)


def train_counts(counts: dict[str, dict[int, int]]) -> PpmModel:
    """Context trees from each language's counts of grams of four bytes, shorter grams being their endings."""
    languages = sorted(k for k, v in counts.items() if v)
    grams = [(np.fromiter(counts[x].keys(), np.int64), np.fromiter(counts[x].values(), np.int64)) for x in languages]
    seen = np.unique(np.concatenate([g.reshape(-1, 1) >> np.array([24, 16, 8, 0]) & 255 for g, _ in grams])) if grams else np.zeros(0, np.int64)
    size = len(seen) + 1
    symbol = np.full(256, size - 1, np.int64)
    symbol[seen] = np.arange(len(seen))
    powers = size ** np.arange(ORDER, -1, -1)
    coded = [((symbol[g.reshape(-1, 1) >> np.array([24, 16, 8, 0]) & 255] * powers).sum(axis=1), n) for g, n in grams]
    model = PpmModel(languages, symbol.astype(np.int32), [], [], [], [])
    width = max(1, len(languages))
    for k in range(ORDER + 1):
        own = []
        for g, n in coded:
            keys, at = np.unique(g % size ** (k + 1), return_inverse=True)
            own.append((keys, np.bincount(at, n, len(keys))))
        keys = np.unique(np.concatenate([x for x, _ in own])) if own else np.zeros(0, np.int64)
        contexts = np.unique(keys // size)
        context = np.full(size ** k, -1, np.int32)
        context[contexts] = np.arange(len(contexts))
        entry = np.full((len(contexts), size), -1, np.int32)
        rows = context[keys // size]
        entry[rows, keys % size] = np.arange(len(keys))
        # What the next shorter context says of each gram's last symbol; it has seen whatever a longer one has.
        if k == 0:
            lower = np.full((len(keys), width), 8.0)
        else:
            short = keys % size ** k
            lower = model.bits[-1][model.entry[-1][model.context[-1][short // size], short % size]].astype(np.float64)
        bits, escape = np.zeros((len(keys), width)), np.zeros((len(contexts), width))
        for i, (mine, n) in enumerate(own):
            at = np.searchsorted(keys, mine)
            count = np.zeros(len(keys))
            count[at] = n
            total, kinds = np.bincount(rows, count, len(contexts)), np.bincount(rows, count > 0, len(contexts))
            whole = np.maximum(total + kinds, 1)
            escape[:, i] = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
            bits[:, i] = np.where(count > 0, -np.log2(np.maximum(count, 1) / whole[rows]), escape[rows, i] + lower[:, i])
        model.context.append(context)
        model.entry.append(entry)
        model.bits.append(bits.astype(np.float32))
        model.escape.append(escape.astype(np.float32))
    return model


def code_lengths(model: PpmModel, raw: np.ndarray, offsets: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Bits that each language's frozen model needs for each whole text."""
    padded, starts = _padded(raw, offsets)
    out = np.zeros((len(starts), max(1, len(model.languages))))
    ends, size = starts + np.diff(offsets), model.entry[0].shape[1]
    for lo in range(0, len(padded), block):
        hi = min(len(padded), lo + block)
        a = max(lo, ORDER)
        if a >= hi:
            continue
        s = model.symbol[padded[a - ORDER:hi]]
        n = hi - a
        last, context = s[ORDER:], (s[:n] * size + s[1:n + 1]) * size + s[2:n + 2]
        bits, left = np.zeros((n, out.shape[1]), np.float32), np.arange(n)
        for k in range(ORDER, -1, -1):
            row = model.context[k][context % size ** k]
            known = row >= 0
            at = np.where(known, model.entry[k][row, last], -1) if len(model.entry[k]) else np.full(len(row), -1)
            hit = at >= 0
            bits[left[hit]] += model.bits[k][at[hit]]
            passed = known & ~hit
            if passed.any():
                bits[left[passed]] += model.escape[k][row[passed]]
            left, context, last = left[~hit], context[~hit], last[~hit]
            if not len(left):
                break
        bits[left] += 8.0
        first, end = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, hi, side="left")
        out[first:end] += segment_sums(bits, np.clip(starts[first:end], a, hi) - a, np.clip(ends[first:end], a, hi) - a)
    return out


def posterior(bits: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Probabilities of the languages; a text longer than EVIDENCE_BYTES counts with its mean code length over so many."""
    scale = np.minimum(1.0, EVIDENCE_BYTES / np.maximum(n_bytes, 1))[:, None]
    p = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * scale)
    return p / p.sum(axis=1, keepdims=True)


def _count():
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, dict[int, int]] = {}
            for first, last, raw, offsets in text_views(batch.column(1)):
                for i in range(last - first):
                    into = total.setdefault(batch.column(0)[first + i].as_py(), {})
                    for g, n in gram_counts(raw[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])).items():
                        into[g] = into.get(g, 0) + n
            for language, grams in total.items():
                yield pa.record_batch([pa.array([language] * len(grams), pa.string()), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], schema=schema)
    return run


def fit(labelled: DataFrame, text: Column, lang: Column, key: Column, per_language: int = SAMPLE_TEXTS) -> PpmModel:
    """A model from a bounded sample: about ``per_language`` whole texts of each language, by the hash of ``key`` and text.

    The texts are counted in tasks; what reaches the driver are counts by gram of four bytes.
    """
    rows = labelled.select(lang.alias("l"), text.alias("t"), F.xxhash64(key, text, F.lit(6)).alias("h")).where("l IS NOT NULL AND t IS NOT NULL AND t != ''")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train_counts({})
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("l"))
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < share * F.lit(float(1 << 30))).select("l", "t")
    got: dict[str, dict[int, int]] = {}
    for r in sample.mapInArrow(_count(), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for language, g, n in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_pylist()):
            got.setdefault(language, {})[g] = n
    return train_counts(got)


def identify(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score.

    ``lang_pred`` is the language whose tree codes the whole text in the fewest bits (ties: the first by name), and
    ``score`` its posterior probability. Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if no language was trained. Repeated rows are scored each; extra columns are not read; an empty table
    gives an empty result.
    """
    packed = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("t"))
    return identify_rows(packed, model).withColumnRenamed("row", id_col)


#: Documents whose best language has a smaller posterior are rejected by ``accepted_documents``.
MIN_SCORE = 0.5


def accepted_documents(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that are undetermined or whose best language scores below ``min_score``; all columns.

    The decision rides on the row itself, so no join is needed and repeated rows are judged each; ids may be null or
    repeat, and columns may have any names. An empty table gives an empty result.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].alias("t"))
    judged = identify_rows(packed, model)
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")


def identify_rows(packed: DataFrame, model: PpmModel) -> DataFrame:
    """Adds lang_pred and score to (row, t), passing ``row`` through."""
    shared = packed.sparkSession.sparkContext.broadcast(model)
    src = packed.select("row", "t", F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, last, raw, offsets in text_views(batch.column(1), 1 << 20):
                n = last - first
                letter = batch.column(2).slice(first, n).to_numpy(zero_copy_only=False).astype(bool)
                names, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
                if m.languages:
                    p = posterior(code_lengths(m, raw, offsets), np.diff(offsets))
                    names[letter] = np.array(m.languages, dtype=object)[p.argmax(axis=1)[letter]]
                    score[letter] = p.max(axis=1)[letter]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(names, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return src.mapInArrow(run, packed.select("row").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
