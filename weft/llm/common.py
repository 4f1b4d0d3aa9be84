"""Shared helpers: table access, the shared scratch folder, written intermediates, Arrow text views."""

from __future__ import annotations

import atexit
import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset (tests), a temporary one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/weft-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already; the folder is scratch space
            return


#: Written white space: space and tab to carriage return. ``collapsed`` matches only runs that must change,
#: so that ordinary single spaces cost no replacement.
_RUNS_TO_CHANGE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def collapsed(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS_TO_CHANGE, " ")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space, as a long; 0 for null."""
    norm = F.trim(collapsed(text))
    spaces = F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(norm == "", F.lit(0)).otherwise(spaces + 1).cast("long")


#: Up to so many keys (20 bytes each) are broadcast by ``without_rows``; beyond, both sides are shuffled.
MAX_BROADCAST_ROWS = 2_000_000


def row_hash(text: Column) -> Column:
    """What tells rows of one id apart: a hash of the text (null as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, id_: Column, hash_: Column, dropped: DataFrame, repeated: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``docs`` less the rows whose (id, hash) is in ``dropped`` and with one of the rows of each (id, hash) in ``repeated``.

    Null ids are equal to null ids. Texts are not shuffled while the keys are few, but for repeated rows.
    """
    tagged = docs.withColumns({"__weft_id": id_, "__weft_hash": hash_})

    def keyed(keys: DataFrame, tag: str) -> tuple[DataFrame, Column, int]:
        keys = written(keys.toDF("__weft_i", "__weft_h").distinct(), tag)
        n = keys.count()
        return F.broadcast(keys) if n <= max_broadcast else keys, F.col("__weft_id").eqNullSafe(F.col("__weft_i")) & (F.col("__weft_hash") == F.col("__weft_h")), n

    keys, same, n = keyed(dropped, "dropped")
    kept = tagged.join(keys, same, "left_anti") if n else tagged
    keys, same, n = keyed(repeated, "repeated")
    if n:
        kept = kept.join(keys, same, "left_anti").unionByName(kept.join(keys, same, "left_semi").dropDuplicates(["__weft_id", "__weft_hash"]))
    return kept.drop("__weft_id", "__weft_hash")


#: Arrays above so many bytes are mapped by themselves in Python workers, and so leave them when freed.
MAPPED_BYTES = 4 << 20


@functools.cache
def frugal_worker() -> None:
    """Once in a Python worker: what is freed goes back to the system. Idle workers stay beside those of later stages, and
    allocators that keep the peak of each would fill an executor. Elsewhere, and without glibc, nothing is changed."""
    if TaskContext.get() is None:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "mallopt"):
        trim_threshold, mmap_threshold = -1, -3  # fixed values: glibc's names for these two
        libc.mallopt(mmap_threshold, MAPPED_BYTES)
        libc.mallopt(trim_threshold, MAPPED_BYTES)


def text_views(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, last row, UTF-8 bytes, row offsets), about ``max_bytes`` each.

    Null counts as empty. A single longer text is a slice of its own, so no text is ever cut.
    """
    frugal_worker()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (the SplitMix64 output function)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15))


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[s:e]`` along axis 0 for each segment; empty segments sum to 0."""
    shape = (len(starts),) + values.shape[1:]
    out = np.zeros(shape, dtype=np.float64 if values.dtype.kind == "f" else values.dtype)
    full = ends > starts
    if full.any():
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        padded = np.concatenate([values, np.zeros((1,) + values.shape[1:], values.dtype)])
        out[full] = np.add.reduceat(padded, edges, axis=0, dtype=out.dtype)[::2]
    return out


def bounded_batches(spark: SparkSession, rows: int = 2000, max_bytes: int = 4 << 20) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def fold_table() -> np.ndarray:
    """Bytes to 64 symbols: 0 white space and controls, 1 digits, 2 to 5 punctuation, 6 to 31 letters without case,
    32 to 63 the low five bits of bytes above 127."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(33, 127):
        c = chr(b)
        table[b] = 1 if c.isdigit() else 6 + ord(c.lower()) - 97 if c.isalpha() else 2 if c in ".,;:!?" else 3 if c in "'-" else 4 if c in '"()[]{}<>' else 5
    table[128:] = 32 + (np.arange(128, 256) & 31)
    return table


SYMBOLS = 64
FOLD = fold_table()
