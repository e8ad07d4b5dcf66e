"""Helpers shared by the operators: table access, text batches as byte arrays,
vectorised word hashing, bounded samples.

Text batches reach Python as Arrow string arrays.  They are cut into slices of
a bounded number of bytes and handled as one ``uint8`` array plus row offsets,
so the work per character is a few numpy passes and no Python string is made
per word.  ASCII white space is ``\\t\\n\\v\\f\\r`` and space.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pinned(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a column that is computed once per row.

    Catalyst copies an expression to where its column is used, also into lambdas, where it
    would be evaluated again for every array element.  A one-element explode stops that."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further fields (name, type)."""
    added = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields]
    return T.StructType([*df.schema.fields, *added])


BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with bounded memory: batches of ``BATCH_BYTES`` at most (a session
    setting, lowered where it is higher), and workers that give their memory back after a
    task, as they are kept for other tasks."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


def release_memory() -> None:
    """Return freed memory of this process to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def worker_memo(key: str, make: Callable):
    """An object that lives as long as the Python process, so that reused workers keep it
    from task to task."""
    home = sys.modules.setdefault("_plotstats_worker_memo", types.ModuleType("_plotstats_worker_memo"))
    if not hasattr(home, key):
        setattr(home, key, make())
    return getattr(home, key)


def text_column(df: DataFrame, name: str = "text"):
    """The column as text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds at most ``max_bytes`` in each,
    unless one row alone is larger."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets) of a string or binary array; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


WHITE = flags(b"\t\n\v\f\r ")
LETTERED = flags(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | flags(bytes(range(128, 256)))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row offset."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.zeros(n + 1, bool)
    cuts[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cuts[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cuts[1:])) + 1
    return starts, ends


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0xD1342543DE82EF95)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_LOWER = _TABLE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _TABLE[ord("a"):ord("z") + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """64-bit hash of each non-empty span of bytes; spans are sorted and disjoint.
    ``lower`` folds A-Z.  Equal bytes hash equally in every process."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    at = np.arange(int(lens.sum()), dtype=np.int64)
    rel = at - np.repeat(first, lens)
    power = np.full(int(lens.max()), _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    part = (_LOWER if lower else _TABLE)[data[rel + np.repeat(starts, lens)]] * power[rel]
    return mix(np.add.reduceat(part, first) + lens.astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """White-space separated words of a batch: (starts, ends, hashes, first word of
    each row with the total appended)."""
    starts, ends = runs(~WHITE[data], offsets)
    return starts, ends, span_hashes(data, starts, ends, lower), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive word hashes that begin at each position
    (positions whose window leaves its row are for the caller to drop)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out ^ hashes[i:i + n]) if i else mix(hashes[:n].copy())
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def bounded_sample(df: DataFrame, key: str, max_rows: int, seed: int = 7) -> DataFrame:
    """About ``max_rows`` rows at most, chosen by a hash of ``key``: all rows when there
    are no more than that.  Only for fitting; rows sharing a key are taken together, so a
    final limit keeps the bound when one key holds many rows."""
    total = df.count()
    if total <= max_rows:
        return df
    cut = int(max_rows / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < cut).limit(2 * max_rows)
