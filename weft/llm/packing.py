"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized once; full sequences are cut off their front and the remainder becomes an item. The histogram
of remainder lengths, rounded up to classes, is bounded whatever the input. Over it a linear program is solved by
column generation: an unbounded-knapsack dynamic program prices new patterns until none saves anything. Patterns are
rounded down, the few items left are packed best-fit, and every class's items, ranked by written partition and
position, are dealt to the slots of the patterns.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import mixed, seeded, text_views, written

CAPACITY = 2048
#: Workers stay, with what they know, beside those of later stages: words that a tokenizer keeps, and bytes of text that it
#: takes at once (a longer text whole).
KNOWN_WORDS, SLICE_BYTES = 300_000, 1 << 18
#: Remainders are rounded up to multiples of this for the program; their true lengths are kept.
CLASS_WIDTH = 4
END_ID = 1


def merge_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``tokenizers`` JSON file; only byte-level BPE whose ids follow its merges is understood."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or spec["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    # Bytes are written as the printable Latin-1 characters that they are, the others as the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
    merged = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if merged != sorted(merged):
        raise ValueError(f"the ids of {path} do not follow its merges")
    return ranks


class PieceTokenizer:
    """Byte-level BPE over whole texts, a word at a time, with a bounded cache of words.

    Pre-tokens are found by vector operations on code points where the text has no apostrophe (contractions need the
    full pattern); each distinct pre-token is encoded once. Ids equal those of the ``tokenizers`` file of the same
    vocabulary, which the tests check.
    """

    def __init__(self, path: str, cache: int = KNOWN_WORDS):
        import tiktoken
        from public_tokenizers import PATTERN

        self.full = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merge_ranks(path), special_tokens={})
        self.piece = self.full._core_bpe.encode_single_piece
        self.limit = cache
        self.kinds = _code_point_kinds()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pre-tokens
        self.place = np.zeros(0, np.int64)  # their place in ``begin``
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if "'" in t:
                out[i] = np.asarray(self.full.encode_to_numpy(t, disallowed_special=()), dtype=np.uint32)
            else:
                plain.append(i)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
            out[i] = ids
        return out  # type: ignore[return-value]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if not lengths.sum():
            return [np.zeros(0, np.uint32) for _ in texts]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        first = np.zeros(n + 1, dtype=bool)  # a text begins here
        edges = np.cumsum(lengths)
        first[0] = True
        first[edges] = True
        kind = self.kinds[points]
        same = np.zeros(n, dtype=bool)
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:n]
        space = kind == 0
        starts = ~same
        # The last white space of a run belongs to what follows: joined to it if a plain space, else on its own.
        followed = np.zeros(n, dtype=bool)
        followed[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        starts |= followed
        glued = np.zeros(n, dtype=bool)
        glued[1:] = (followed & (points == 32))[:-1]
        starts &= ~glued
        s = np.flatnonzero(starts)
        e = np.append(s[1:], n)
        with np.errstate(over="ignore"):
            prefix = np.zeros(n + 1, np.uint64)
            up, down = _powers(n)
            np.cumsum(mixed(points.astype(np.uint64) + np.uint64(0x51ED27)) * up[:n], dtype=np.uint64, out=prefix[1:])
            h = mixed((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        self._learn(unique, joined, s[at], e[at])
        u = self.place[np.searchsorted(self.keys, unique)]
        begin, count = self.begin[u][inverse], self.count[u][inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        where = np.arange(total[-1]) - np.repeat(total[:-1] - begin, count)
        ids = self.ids[where]
        cuts = total[np.searchsorted(s, edges[:-1])] if len(edges) > 1 else []
        return np.split(ids, cuts)

    def _learn(self, unique: np.ndarray, joined: str, s: np.ndarray, e: np.ndarray) -> None:
        if len(self.keys) + len(unique) > self.limit:
            self._reset()
        spot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        piece = self.piece
        coded = [piece(joined[a:b].encode("utf-8", "replace")) for a, b in zip(s[new].tolist(), e[new].tolist())]
        count = np.array([len(c) for c in coded], np.int64)
        begin = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.ids = np.concatenate([self.ids, np.fromiter((x for c in coded for x in c), np.uint32, int(count.sum()))])
        keys = np.concatenate([self.keys, unique[new]])
        place = np.concatenate([self.place, len(self.begin) + np.arange(len(new))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], place[order]
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])


_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) <= n:
        base = int(seeded(1, 5)[0]) | 1
        size = max(n + 1, SLICE_BYTES)
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)]), dtype=np.uint64)
                            for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS


def _code_point_kinds() -> np.ndarray:
    """0 white space, 1 letters, 2 numbers, 3 everything else, for all code points, as the pattern's classes say."""
    import regex

    kinds = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for value, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (0, r"\s")):
        for m in regex.finditer(pattern + "+", every):
            kinds[ord(every[m.start()]):ord(every[m.end() - 1]) + 1] = value
    return kinds


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer_at(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


@dataclass
class Plan:
    """Patterns with multiplicities, and where each class's ranks go."""

    patterns: list[np.ndarray] = field(default_factory=list)  # counts by class
    times: list[int] = field(default_factory=list)

    def slots(self, classes: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By class: first rank, first sequence, items of the class in the pattern, and slots before them."""
        base = np.concatenate([[0], np.cumsum(self.times)]).astype(np.int64)
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks = np.zeros(classes + 1, np.int64)
        for j, p in enumerate(self.patterns):
            before = 0
            for c in np.flatnonzero(p)[::-1]:
                out.setdefault(int(c), []).append((int(ranks[c]), int(base[j]), int(p[c]), before))
                ranks[c] += int(p[c]) * self.times[j]
                before += int(p[c])
        return {c: tuple(np.array(x, np.int64) for x in zip(*rows)) for c, rows in out.items()}  # type: ignore[misc]

    @property
    def sequences(self) -> int:
        return int(sum(self.times))


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of classes 1..capacity (class c has size c) by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        options = best[room - 1::-1] + values[1:room + 1]  # class 1 leaves room - 1, ..., class room leaves 0
        k = int(options.argmax())
        if options[k] > best[room - 1]:
            best[room], choice[room] = options[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room]] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, max_rounds: int = 3000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (a column for each demanded class) and their amounts, optimal for the linear program.

    ``demand[c]`` items of size c must be cut from stock of size ``capacity``. The revised simplex method starts from
    patterns of one class each and adds the pattern that the knapsack prices best until its value is at most 1.
    """
    rows = np.flatnonzero(demand)
    m = len(rows)
    basis = np.zeros((capacity + 1, m), np.int64)
    for i, c in enumerate(rows):
        basis[c, i] = capacity // c
    inverse = np.diag(1.0 / basis[rows, np.arange(m)])
    x = inverse @ demand[rows].astype(float)
    for step in range(max_rounds):
        if step and step % 200 == 0:
            inverse = np.linalg.inv(basis[rows].astype(float))
            x = np.maximum(inverse @ demand[rows].astype(float), 0)
        duals = np.zeros(capacity + 1)
        duals[rows] = inverse.sum(axis=0)
        value, pattern = knapsack(np.maximum(duals, 0), capacity)
        if value <= 1 + tolerance:
            break
        pattern[np.setdiff1d(np.arange(capacity + 1), rows)] = 0
        direction = inverse @ pattern[rows].astype(float)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / direction[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * direction
        x[out] = theta
        np.maximum(x, 0, out=x)
        basis[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    return basis, x


def best_fit(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Best-fit decreasing over the few items that rounding left."""
    bins: list[np.ndarray] = []
    room: list[int] = []
    for c in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[c])):
            fits = [(r, i) for i, r in enumerate(room) if r >= c]
            if fits:
                _, i = min(fits)
            else:
                bins.append(np.zeros(capacity + 1, np.int64))
                room.append(capacity)
                i = len(bins) - 1
            bins[i][c] += 1
            room[i] -= int(c)
    return bins


def cutting_plan(demand: np.ndarray, capacity: int) -> Plan:
    """Whole patterns that hold exactly ``demand`` items of each class."""
    plan = Plan()
    if not demand.any():
        return plan
    basis, x = column_generation(demand, capacity)
    left = demand.copy()
    for j in np.argsort(-x, kind="stable"):
        used = basis[:, j] > 0
        times = min(int(x[j] + 1e-6), int((left[used] // basis[used, j]).min())) if used.any() else 0
        if times > 0:
            plan.patterns.append(basis[:, j].copy())
            plan.times.append(times)
            left -= times * basis[:, j]
    for p in best_fit(left, capacity):
        plan.patterns.append(p)
        plan.times.append(1)
    return plan


def _pieces(path: str, capacity: int, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("part", pa.int64()), ("cls", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = tokenizer_at(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for first, last, _, _ in text_views(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(first, last - first).to_pylist()
                rows = []
                for doc, tokens in zip(ids, tokenizer.encode_many(batch.column(1).slice(first, last - first).to_pylist())):
                    tokens = np.append(tokens, np.uint32(END_ID)).astype("<u4")
                    n = len(tokens)
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        c = -(-length // width)
                        crc = zlib.crc32(tokens[start:start + length].tobytes())
                        rows.append((doc, start, length, crc, n, part, c, seen.get(c, 0)))
                        seen[c] = seen.get(c, 0) + 1
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _assign(slots: dict, full_class: int, first_full: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("slot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column("cls").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = first_full + rank, np.zeros(len(rank), np.int64)
            for c in np.unique(cls):
                if c == full_class:
                    continue
                at = np.flatnonzero(cls == c)
                ranks, base, each, before = slots[int(c)]
                j = np.searchsorted(ranks, rank[at], side="right") - 1
                k = rank[at] - ranks[j]
                sequence[at] = base[j] + k // each[j]
                slot[at] = before[j] + k % each[j]
            yield pa.record_batch([batch.column(n) for n in schema.names[:5]] + [pa.array(sequence), pa.array(slot)], schema=schema)
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, class_width: int = CLASS_WIDTH) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null text: none, so the end id alone) are cut into pieces of ``capacity`` from the front; the
    remainder is one piece, never cut again. Sequences are numbered from 0 without gaps, pieces lie in them without
    gaps, and each id lies in exactly one piece. Rows that repeat a document, and rows with a null id, are packed each
    for itself. Equal lengths are dealt in the order of written partitions. An empty table gives an empty result;
    extra columns are not read. ``capacity`` must be a multiple of ``class_width``.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, cls int, nth long"
    pieces = written(src.mapInArrow(_pieces(tokenizer_path, capacity, class_width), ddl), "pack-pieces")
    counts = written(pieces.groupBy("cls", "part").agg(F.count("*").alias("n")), "pack-counts")
    top = capacity // class_width
    demand = np.zeros(top + 1, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most capacity / class_width rows
        demand[r["cls"]] = r["n"]
    demand[top] = 0  # full pieces are sequences of their own
    plan = cutting_plan(demand, top)
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = pieces.join(offsets, ["cls", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("nth") + F.col("skip")).alias("rank"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    dealt = ranked.mapInArrow(_assign(plan.slots(top), top, plan.sequences), ddl)
    # A sequence holds at most ``capacity`` pieces.
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("slot")
    return out.withColumnRenamed("doc_id", id_col)
