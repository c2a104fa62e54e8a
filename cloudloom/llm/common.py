"""Shared helpers of the training-data operators: table access, shared scratch space, Arrow text kernels.

The text kernels work on the UTF-8 buffer of a whole Arrow column at once, so that the cost per word is a few
vectorised passes and never a Python call.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel handles at once; bounds a Python worker's memory, never what is processed.
CHUNK_BYTES = 2_000_000

#: Rows of an Arrow batch that is sent to a Python worker; texts can be long, so the usual 10,000 are too many.
BATCH_ROWS = 1000

_U = np.uint64


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that from now on sends at most BATCH_ROWS rows to a Python worker at once: Spark reads it when a query runs."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def lean(work: Callable) -> Callable:
    """work (of record batches, in a Python worker) with large blocks returned to the system as soon as they are freed.

    Workers are used again by later tasks; what one kernel needed at most would else stay with the worker.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch], *args: object) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        glibc = hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim")
        if glibc:
            libc.mallopt(-3, 8 << 20)  # blocks of 8 MB and more are mapped, and unmapped when freed
            libc.mallopt(-8, 2)  # few arenas
        yield from work(batches, *args)
        pa.default_memory_pool().release_unused()
        if glibc:
            libc.malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only where unset and all runs on one machine) a new one."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not own and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="cloudloom-"))
    return own or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: rows and partitions are the same however often they are read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); a bijection, so it adds no collisions."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets into them) of a string column, nulls as empty texts.

    A chunk ends after the row that reaches the limit, so a row of any length is whole in one chunk.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit)))
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Bytes that separate words: blank and 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that are hashed at once.
HASHED_BYTES = 1 << 18
#: A random value for each byte at each of 64 places of a word; further places multiply them by a factor of their block of 64.
_PLACES = 64
_VALUES = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in data, and the first word of each document (one more at the end)."""
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    cuts = cuts[cuts > 0] - 1
    ends[cuts] = inside[cuts]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a sum of random values of its (place, byte) pairs, for runs of words at once.

    The values are no powers of one base, so no pattern of bytes makes two words collide; equal hashes of different words
    are as rare as chance makes them (2**-64 a pair). Who must not take one word for another compares bytes as well.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            begin = starts[i]
            j = max(i + 1, int(np.searchsorted(stops, begin + HASHED_BYTES, "right")))
            n = int(stops[j - 1] - begin)
            a, z = starts[i:j] - begin, stops[i:j] - begin
            place = np.arange(n) - np.repeat(a, np.diff(np.append(a, n)))
            codes = data[begin : begin + n] if lower is None else lower[data[begin : begin + n]]
            values = _VALUES.take((place & (_PLACES - 1)) << 8 | codes)
            far = np.flatnonzero(place >= _PLACES)
            if len(far):
                values[far] *= mix((place[far] // _PLACES).astype(np.uint64)) | _U(1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            out[i:j] = sums[z] - sums[a] ^ ((z - a).astype(np.uint64) << _U(48))
            i = j
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences in document order, and where each document's begin (one more at the end).

    A document with fewer words has its whole sequence as its only one; without words it has none.
    """
    counts = np.diff(first)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    where = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(where[-1], np.uint64)
    factors = constants(k + 1, 77)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            rolled = sum(words[j : len(words) - k + 1 + j] * factors[j] for j in range(k))
            full = np.repeat(counts >= k, own)
            at = np.arange(where[-1]) - np.repeat(where[:-1], own) + np.repeat(first[:-1], own)
            out[full] = rolled[at[full]]
        for d in np.flatnonzero((counts < k) & (counts > 0)):
            w = words[first[d] : first[d + 1]]
            out[where[d]] = np.add.reduce(w * factors[: len(w)]) + factors[k] * _U(len(w))
    return mix(out), where
