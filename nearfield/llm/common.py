"""Shared pieces of the operators: word splitting and hashing in numpy, shared tables, connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored, work_folder

#: A word is a run of characters other than these six (space, \t, \n, \v, \f, \r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_BREAK_BYTES = (9, 10, 11, 12, 13, 32)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once in a Python worker, unless one text alone is longer.
CHUNK_BYTES = 2 << 20


shared_folder, written = work_folder, stored


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  one table per worker
    have = cache.get("n", 0)
    if have < n:
        size = max(n, CHUNK_BYTES + 64)
        with np.errstate(over="ignore"):
            cache["up"] = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, _BASE, np.uint64))))
            cache["down"] = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, _INVERSE, np.uint64))))
        cache["n"] = size
    return cache["up"], cache["down"]


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, start = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[start : start + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def tidy() -> None:
    """Give memory that a worker has freed back to the system: workers live on and stand beside each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Slices of a batch whose texts have about ``most`` bytes together; a longer text is a slice of its own."""
    _, offsets = utf8_column(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end
    tidy()


_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAK_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a chunk of texts: byte ranges, the first word of each text, and 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8_column(column)
        if lower:
            self.data = _LOWER[self.data]
        inside = ~_BREAK[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words first[i] to first[i + 1] - 1 are those of text i
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial modulo 2^64 over random byte values, finalised.

        Works on stretches of whole words, so its tables have a fixed size however long a text is.
        """
        values = mixed(np.arange(1, 257, dtype=np.uint64))
        out = np.empty(len(self), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(self):
                base = int(self.starts[at])
                to = max(at + 1, int(np.searchsorted(self.ends, base + CHUNK_BYTES, "right")))
                starts, ends = self.starts[at:to] - base, self.ends[at:to] - base
                up, down = powers(int(ends[-1]) + 1)
                sums = np.zeros(int(ends[-1]) + 1, np.uint64)
                np.cumsum(values[self.data[base : base + int(ends[-1])]] * up[: int(ends[-1])], out=sums[1:])
                hashed = (sums[ends] - sums[starts]) * down[starts]
                out[at:to] = mixed(hashed + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                at = to
        return out

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


#: Keys that a join may take for hot, at most.
HOT_KEYS = 1000


def join_skewed(rows: DataFrame, table: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and in ``n`` how many of ``rows`` have it.

    A key that more than a thousandth of the rows have would make one task long.  There are fewer than ``HOT_KEYS`` of
    those, so their part of the table is broadcast and their rows stay where they are; all others meet in the shuffle.
    Both are read more than once, so they should be written tables.  ``how``: inner or left.
    """
    most = max(HOT_KEYS, rows.count() // HOT_KEYS)
    hot = table.where(F.col(n) > most)
    if hot.isEmpty():
        return rows.join(table.drop(n), key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(n) <= most).drop(n), key, how)
    return rows.join(F.broadcast(hot.drop(n)), key).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of ``edges`` the smallest node that it can reach.

    Alternates large-star and small-star steps, so the rounds grow with the logarithm of the longest path; each round
    aggregates with map-side partials, so a hub is no hot key, and is written to the shared folder.  Null edges go.
    """
    current = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    current = written(current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_written(current)
        current = after
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

