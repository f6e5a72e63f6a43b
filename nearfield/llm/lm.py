"""LM scoring by deleted interpolation.

A token's probability mixes maximum-likelihood estimates: of the bigram, of the word alone, and the uniform one,

    P(w | v) = a[b] c(v, w) / c(v) + u[b] c(w) / N + z[b] / (V + 1),

with weights a, u, z for each bucket b of context frequencies, b = log2 of c(v).  The weights are learned by
expectation-maximisation on held-out counts: fold ``HELD_FOLD`` of the training documents is deleted from the counts, and
its tokens are what the deleted estimates must predict.  The scores then use the counts of all training documents.

Counts are exact, 64 bits wide and global.  A task packs about ``BLOCK_BYTES`` of text into a block: its distinct word
hashes and each token's place among them, from which the sorted distinct 56-bit hashes of its words and bigrams follow
whenever they are needed.  Sums are made in levels.  A block sends its hashes with its own counts in 2 ** ``FAN_BITS``
slices of the hash range; as many blocks form a rack, and a rack's slice is added up by one group.  Racks of racks go on
with the next bits of the hash until one rack is left, and the totals return the same way, in the order in which they were
asked for.  So a level has the same number of rows for each block whatever the number of blocks, a group holds about as
much as a block does, a frequent word is one entry of a block, and nothing of the corpus is collected: EM gets a histogram
of bucketed estimates of a fixed size.  Blocks are a bucketed table in the shared folder, so they are not shuffled to meet
the totals.

The order is two: trigrams would more than double the entries, which are nearly all of what is shuffled.

Null and empty texts have one token, the end.  Texts of any length are one block at most, and counted whole.  Rows without
an id are of fold 0.  Repeated rows count each time.  With no training tokens at all the score is that of the uniform
estimate.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, mixed, shared_folder, written

FOLDS, TEST_FOLD, HELD_FOLD = 7, 2, 3
BUCKETS = 24
BLOCK_BYTES = 4 << 20
#: A block's entries go out in 2 ** FAN_BITS slices, and as many blocks form a rack.
FAN_BITS = 8
#: log10 cells of an estimate's histogram: 1e-10 to 1, and one for zero.
CELLS, CELL_WIDTH = 120, 0.085
EM_STEPS = 60
_BITS = 56
_MASK = np.uint64((1 << _BITS) - 1)
END, START = np.uint64(0x51ED270B0A1F39C1), np.uint64(0xA24BAED4963EE407)


def packed(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, deflated lightly: small ones take little."""
    planes = np.ascontiguousarray(x.astype(f"<u{x.itemsize}").view(np.uint8).reshape(-1, x.itemsize).T)
    return zlib.compress(planes.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(f"<u{np.dtype(kind).itemsize}").reshape(-1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, the end of each text included, and the tokens of each text."""
    words = Words(texts, lower=True)
    counts = words.counts + 1
    out = np.full(counts.sum(), END, np.uint64)
    out[np.arange(len(words)) + words.text_of_word()] = words.hashes()
    return out, counts


def grams(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its 56-bit hash (even), that of its bigram (odd), and whether it is its text's first."""
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(counts) - counts] = True
    before = np.concatenate(([START], tokens[:-1])) if len(tokens) else tokens
    before = np.where(first, START, before)
    with np.errstate(over="ignore"):
        pair = mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens))
    return (tokens & _MASK) & ~np.uint64(1), (pair & _MASK) | np.uint64(1), first


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a block: ids, folds, tokens of each text, the distinct tokens' hashes, and each token's place among them."""
    schema = T.StructType(
        [T.StructField("block", T.LongType())]
        + [T.StructField(n, T.ArrayType(t)) for n, t in (("ids", T.LongType()), ("folds", T.IntegerType()), ("sizes", T.LongType()))]
        + [T.StructField(n, T.BinaryType()) for n in ("words", "places")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", block_bytes):
                number += 1
                tokens, sizes = tokens_of(part.column("text"))
                folds = part.column("fold").to_numpy(zero_copy_only=False)
                words, places = np.unique(tokens, return_inverse=True)
                rows = [pa.array([number], pa.int64())] + [pa.array([x.tolist()], t) for x, t in ((part.column("id"), pa.list_(pa.int64())), (folds, pa.list_(pa.int32())), (sizes, pa.list_(pa.int64()))) ]
                blobs = [packed(words), packed(places.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(rows + [pa.array([b], pa.binary()) for b in blobs], names=schema.names)

    fold = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")
    return docs.select(F.col(doc_id).alias("id"), fold.alias("fold"), F.col(text).alias("text")).mapInArrow(run, schema)


BLOCK = ("block", "ids", "folds", "sizes", "words", "places")


class Block:
    """A row of ``blocks``: its texts, the sorted distinct words and bigrams, and each token's place among these."""

    def __init__(self, row: dict):
        self.ids, self.folds, self.sizes = row["ids"], np.array(row["folds"]), np.array(row["sizes"])
        tokens = unpacked(row["words"], np.uint64)[unpacked(row["places"], np.uint32)]
        one, two, self.first = grams(tokens, self.sizes)
        self.keys, place = np.unique(np.concatenate((one, two)), return_inverse=True)
        self.one, self.two = place[: len(one)], place[len(one) :]

    def counted(self, texts: np.ndarray) -> np.ndarray:
        """How often each key is in the chosen texts."""
        own = np.repeat(texts, self.sizes)
        return (np.bincount(self.one[own], minlength=len(self.keys)) + np.bincount(self.two[own], minlength=len(self.keys))).astype(np.uint32)


def _bucketed(df: DataFrame, label: str, column: str, n: int) -> DataFrame:
    """``df`` as a table bucketed by ``column`` in the shared folder; it goes when the application ends.

    The name is taken out of the catalog again at once: the DataFrame knows its files and their buckets.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.format("parquet").bucketBy(n, column).option("path", path).option("compression", "snappy").saveAsTable(name)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.table(name)
    out.schema  # resolved before the name goes  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return out


#: Entries of a member (a block, or a rack's slice ``path``) in the slice ``part`` of its rack.
PARTS = "rack long, part long, unit long, path long, keys binary, trained binary, held binary"
#: What comes back to a member for each of its parts.
ANSWERS = "unit long, path long, part long, trained binary, held binary"
_SUMS = ("trained", "held")


def _cut(keys: np.ndarray, counts: list[np.ndarray], rack: int, unit: int, path: int, known: int, bits: int) -> pa.RecordBatch:
    """A member's rows of ``PARTS``: its keys have the first ``known`` bits ``path`` and are cut by the next ``bits``."""
    first = path << bits
    low = (np.arange(1 << bits, dtype=np.uint64) + np.uint64(first)) << np.uint64(_BITS - known - bits)
    edges = [*np.searchsorted(keys, low).tolist(), len(keys)]
    out = [(rack, first + p, unit, path, packed(np.diff(keys[a:b], prepend=np.uint64(0))), *(packed(c[a:b].astype(np.uint64)) for c in counts)) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["rack", "part", "unit", "path", "keys", *_SUMS])


def _keys_of(rows: list[dict]) -> list[np.ndarray]:
    return [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]


def _added(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of some members' rows of one slice: each one's keys, all distinct keys, the members' places in them, and the sums."""
    keys = _keys_of(rows)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for c in _SUMS:
        total = np.zeros(len(found), np.uint64)
        np.add.at(total, place, np.concatenate([unpacked(r[c], np.uint64) for r in rows]))
        sums.append(total)
    return keys, found, place, sums


def _answered(rows: list[dict], keys: list[np.ndarray], place: np.ndarray, sums: list[np.ndarray]) -> list[pa.Array]:
    """The columns of ``ANSWERS``: to each member the sums in the order of its own keys."""
    edges = np.cumsum([0, *map(len, keys)]).tolist()
    back = [[packed(total[place[a:b]]) for a, b in zip(edges, edges[1:], strict=False)] for total in sums]
    return [*(pa.array([r[c] for r in rows], pa.int64()) for c in ("unit", "path", "part")), *(pa.array(x, pa.binary()) for x in back)]


def _ordered(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["unit"], r["path"]))


def slices(table: DataFrame, bits: int, rack_bits: int) -> DataFrame:
    """``PARTS`` of the blocks, in 2 ** ``bits`` slices, dealt to 2 ** ``rack_bits`` racks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                counts = [block.counted(block.folds != TEST_FOLD), block.counted(block.folds == HELD_FOLD)]
                rack = int(mixed(np.array([row["block"]], np.uint64))[0]) & ((1 << rack_bits) - 1)
                yield _cut(block.keys, counts, rack, row["block"], 0, 0, bits)

    return table.select(*BLOCK).mapInArrow(run, PARTS)


def combined(parts: DataFrame, known: int, bits: int, fan: int = FAN_BITS) -> DataFrame:
    """``PARTS`` of the next level: each rack's slice is one member, cut by the ``bits`` that follow the ``known`` ones."""

    def run(table: pa.Table) -> pa.Table:
        rows = _ordered(table)
        _, found, _, sums = _added(rows)
        return pa.Table.from_batches([_cut(found, sums, rows[0]["rack"] >> fan, rows[0]["rack"], rows[0]["part"], known, bits)])

    return parts.groupBy("rack", "part").applyInArrow(run, PARTS)


def totals(parts: DataFrame) -> DataFrame:
    """``ANSWERS`` of the last level, where one rack is left, with n_trained, n_held and n_types.

    Those three, of the words of a slice, stand in the row of its first member alone.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = _ordered(table)
        keys, found, place, sums = _added(rows)
        word = found & np.uint64(1) == 0
        first = lambda x: pa.array([int(x), *[0] * (len(rows) - 1)], pa.int64())
        return pa.table([*_answered(rows, keys, place, sums), first(sums[0][word].sum()), first(sums[1][word].sum()), first((sums[0][word] > 0).sum())], names=["unit", "path", "part", *_SUMS, "n_trained", "n_held", "n_types"])

    return parts.groupBy("part").applyInArrow(run, f"{ANSWERS}, n_trained long, n_held long, n_types long")


def passed_down(parts: DataFrame, above: DataFrame) -> DataFrame:
    """``ANSWERS`` of a level from those that its racks' slices got from the level above."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _ordered(table)
        keys = _keys_of(rows)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        got = sorted(answers.to_pylist(), key=lambda a: a["part"])
        sums = [np.concatenate([unpacked(a[c], np.uint64) for a in got]) for c in _SUMS]
        return pa.table(_answered(rows, keys, place, sums), names=["unit", "path", "part", *_SUMS])

    # the unit and path of the answers above are the rack and part here
    return parts.groupBy("rack", "part").cogroup(above.groupBy("unit", "path")).applyInArrow(run, ANSWERS)


def counted(table: DataFrame, fan: int = FAN_BITS) -> tuple[DataFrame, tuple[int, int, int]]:
    """``ANSWERS`` of the blocks, and the training tokens, those of the held-out fold, and the distinct training tokens."""
    left = max(0, int(table.count()) - 1).bit_length()  # bits that number the members that are left
    racks = max(0, left - fan)
    levels = [slices(table, fan, racks)]
    known = fan
    while racks:
        left, racks = racks, max(0, racks - fan)
        levels.append(written(combined(levels[-1], known, min(fan, left), fan), "racks"))
        known += min(fan, left)
    answers = written(totals(levels[-1]), "totals")
    n = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_trained", "n_held", "n_types"))).first()
    for parts in levels[-2::-1]:
        answers = written(passed_down(parts, answers), "totals")
    return answers, tuple(n)


class Resolved(Block):
    """A block with the corpus counts of its words and bigrams, as training has them and as the held-out fold has."""

    def __init__(self, row: dict, answers: list[dict]):
        super().__init__(row)
        answers = sorted(answers, key=lambda a: a["part"])
        self.trained, self.held = (np.concatenate([unpacked(a[c], np.uint64) for a in answers]).astype(np.int64) for c in _SUMS)
        self.end = int(np.searchsorted(self.keys, (END & _MASK) & ~np.uint64(1)))

    def estimates(self, counts: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, bigram estimate, word estimate) of each token."""
        word, pair = counts[self.one].astype(float), counts[self.two].astype(float)
        context = np.concatenate(([0.0], word[:-1]))
        context[self.first] = counts[self.end]  # a text begins as often as one ends
        bucket = np.minimum(np.log2(np.maximum(context, 0.5)).astype(np.int64) + 1, BUCKETS - 1) * (context > 0)
        return bucket, np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0), word / max(n, 1.0)


def _met(table: DataFrame, answers: DataFrame, build, schema: str) -> DataFrame:
    """``build`` of each resolved block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return build([Resolved(row, right.to_pylist()) for row in left.to_pylist()])

    return table.select(*BLOCK).groupBy("block").cogroup(answers.groupBy("unit")).applyInArrow(run, schema)


def _cell(x: np.ndarray) -> np.ndarray:
    """0 for zero, else 1 (at most 1e-10) to CELLS (1)."""
    return np.where(x > 0, np.clip(CELLS - 1 + np.round(np.log10(np.maximum(x, 1e-300)) / CELL_WIDTH), 0, CELLS - 1) + 1, 0).astype(np.int64)


def held_histogram(table: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """(cell, tokens, pair, word): held-out tokens by bucket and estimates without their fold, and the estimates' sums.

    ``n``: tokens that the estimates are taken from.  A cell's estimates differ by up to 22 % from
    edge to edge; EM takes their exact means.
    """
    names = ["cell", "tokens", "pair", "word"]

    def build(found: list[Resolved]) -> pa.Table:
        cells, pairs, words = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for x in found:
            bucket, pair, word = x.estimates(x.trained - x.held, n)
            own = np.repeat(x.folds == HELD_FOLD, x.sizes)
            cells.append(((bucket * (CELLS + 1) + _cell(pair)) * (CELLS + 1) + _cell(word))[own])
            pairs.append(pair[own])
            words.append(word[own])
        cell, place = np.unique(np.concatenate(cells), return_inverse=True)
        sums = [np.bincount(place, w, len(cell)) for w in (None, np.concatenate(pairs), np.concatenate(words))]
        return pa.table([pa.array(cell), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float))], names=names)

    rows = _met(table, answers, build, "cell long, tokens long, pair double, word double")
    return rows.groupBy("cell").agg(*(F.sum(c).alias(c) for c in names[1:]))


def learned_weights(cells: np.ndarray, tokens: np.ndarray, pair: np.ndarray, word: np.ndarray, n_types: int) -> np.ndarray:
    """(BUCKETS, 3) mixture weights by EM; a bucket without held-out tokens has those of all tokens together."""
    bucket = cells // (CELLS + 1) ** 2
    parts = np.stack([pair / np.maximum(tokens, 1), word / np.maximum(tokens, 1), np.full(len(cells), 1.0 / (n_types + 1))], 1)

    def em(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start
        for _ in range(EM_STEPS):
            share = parts[rows] * weights
            share *= (tokens[rows] / share.sum(1))[:, None]
            weights = share.sum(0) / share.sum()
            weights = np.maximum(weights, 1e-9)  # the uniform part never goes: no token has probability zero
            weights /= weights.sum()
        return weights

    even = np.full(3, 1 / 3)
    if not len(cells):
        return np.tile(even, (BUCKETS, 1))
    whole = em(np.ones(len(cells), bool), even)
    return np.stack([em(bucket == b, whole) if (bucket == b).any() else whole for b in range(BUCKETS)])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN_BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    made = blocks(docs, doc_id, text, block_bytes)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _bucketed(made, "blocks", "block", buckets)
    answers, (n, n_held, n_types) = counted(table, fan)
    histogram = held_histogram(table, answers, n - n_held).toPandas()  # at most BUCKETS * (CELLS + 1)^2 rows, whatever the input
    histogram = histogram.sort_values("cell").astype({"tokens": float})
    weights = learned_weights(*(histogram[c].to_numpy() for c in ("cell", "tokens", "pair", "word")), n_types)

    def build(found: list[Resolved]) -> pa.Table:
        out = []
        for x in found:
            bucket, pair, word = x.estimates(x.trained, n)
            w = weights[bucket]
            own = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (n_types + 1))
            count = x.trained[x.one]
            base = np.log10((count + 1) / (n + n_types + 1))
            starts = np.cumsum(x.sizes) - x.sizes
            add = lambda y: np.add.reduceat(y, starts) if len(starts) else y[:0]  # noqa: E731,B023
            out.append(pa.table([pa.array(x.ids, pa.int64()), pa.array(x.folds == TEST_FOLD), pa.array(x.sizes, pa.int64()), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(x.sizes), n, np.int64)), pa.array(add(base)), pa.array(add(own))], names=names))
        return pa.concat_tables(out) if out else pa.schema([(f, t) for f, t in zip(names, kinds, strict=True)]).empty_table()

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return _met(table, answers, build, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
