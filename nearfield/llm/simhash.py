"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees, and their connected components.

A fingerprint bit is set if it is set in over half of the 64-bit hashes of a text's word shingles.  Equal fingerprints
are one node, named by its smallest document id, so that a component's smallest node is its result.  Fingerprints within ``RADIUS`` bits agree on at least ``SHARED`` of ``BLOCKS`` blocks of bits, so each goes
to one shard for every choice of ``SHARED`` blocks, keyed by those bits.  A shard is a BK-tree: a child hangs from its
parent by an edge numbered with their Hamming distance, and a query at distance d from a node follows only the edges
d - RADIUS to d + RADIUS.  Trees of all shards of a task are built and searched level by level in numpy.  Shards aren't
broadcast, as they grow with the data: queries meet them in the shuffle.  A shard of more than ``SHARD_LIMIT``
fingerprints is cut into groups, and each pair of groups is a tree of its own, so no task holds more.  A task gives its
links as stars, not as pairs.

A radius of a few bits finds copies that differ in a few words of many.  ``components`` with a ``similarity`` also links
nearer kin that SimHash alone can't tell: documents are dealt to shards by bands of min-hashes of the same shingles, and
every pair of a shard is verified by the Jaccard similarity of the texts' sets of shingles; those that reach it are links
as well.  In a shard of more than ``SMALL`` members only pairs that verified links already connect are left out, and pairs
without a common shingle among the rarest of each, which can't reach it.

Null and empty texts have fingerprint zero and are linked like any other.  Texts of any length are hashed whole.  Rows
without an id have a fingerprint and the component of the others; the component is null where no row of it has an id.  A
node without an id is named by a number from 2^62 on, made of its fingerprint, so ids must be smaller.  Repeated rows give
repeated results; of texts with one fingerprint that of the smallest id is compared by similarity, of rows that repeat that
id the least one.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, connected_components, join_skewed, mixed, tidy, written
from .substring import Shingles

WORDS, SEED, RADIUS = 4, 42, 4
BLOCKS, SHARED = 6, 2
SHARD_LIMIT = 20_000
#: Up to so many members of a band's shard their pairs are verified one by one; of larger shards so many shingles in a cell.
SMALL, SHARD_SHINGLES = 16, 4_000_000
BANDS, BAND_BINS = 12, 3
#: From here on a number names a node of which no row has an id.
NAMELESS = 1 << 62
_SUM_ROWS = 1 << 16
_BLOCK = 1 << 20


def shingle_hashes(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, one text after the other, and how many each has."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    counts = []
    for text in texts.to_pylist():
        found = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and only ASCII spaces cut
        if not found:
            counts.append(0)
            continue
        joined = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(joined, seed))
            counts.append(1)
            continue
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
        counts.append(len(starts))
    return np.array(hashes, np.uint64), np.array(counts, np.int64)


def majority(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One uint64 a text: the bits that over half of its hashes have."""
    if not len(n):
        return np.zeros(0, np.uint64)
    totals = np.zeros((len(n), 64), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(raw), _SUM_ROWS):
        bits = np.unpackbits(raw[at : at + _SUM_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + _SUM_ROWS]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        totals[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * totals > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def band_keys(raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS) keys of one-permutation min-hashes, and where a key has any hash in it."""
    values = mixed(raw)
    least = np.full(len(n) * BANDS * BAND_BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, np.repeat(np.arange(len(n)), n) * (BANDS * BAND_BINS) + (values % np.uint64(BANDS * BAND_BINS)).astype(np.int64), values)
    least = least.reshape(len(n), BANDS, BAND_BINS)
    key = np.zeros((len(n), BANDS), np.uint64)
    for k in range(BAND_BINS):
        key = mixed(key * np.uint64(3) + least[:, :, k])
    return key, (least != np.iinfo(np.uint64).max).any(2)


def fingerprints(df: DataFrame, text: str = "text", column: str = "fingerprint", words: int = WORDS, seed: int = SEED, bands: str | None = None) -> DataFrame:
    """``df`` without its text, with the fingerprint as a signed long and, if ``bands`` names them, its band keys."""
    kept = [f for f in df.schema.fields if f.name not in (text, column, bands)]
    added = [T.StructField(column, T.LongType())] + ([T.StructField(bands, T.ArrayType(T.LongType()))] if bands else [])
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, 2 << 20):
                raw, n = shingle_hashes(part.column(text), words, seed)
                columns = [*(part.column(f.name) for f in kept), pa.array(majority(raw, n).view(np.int64))]
                if bands:
                    keys, real = band_keys(raw, n)
                    flat = pa.array(keys.view(np.int64).ravel(), mask=~real.ravel())
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), flat))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if f in kept or f.name == text]).mapInArrow(run, schema)


def block_masks(blocks: int = BLOCKS, shared: int = SHARED) -> list[int]:
    """A mask of the bits of each choice of blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(one, shared)]


class BKForest:
    """A BK-tree for each shard: a node's children are runs of one table, sorted by (parent, distance)."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """``shard``: a number for each value, in order.  The first value of a shard is its root."""
        n = len(values)
        self.values = values
        first = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        edges = []
        below = np.flatnonzero(~first)
        parent = self.root[below]
        while len(below):
            apart = np.bitwise_count(values[below] ^ values[parent]).astype(np.int64)
            key = parent * 65 + apart
            found, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = below[at]  # the first at a distance becomes the child, the others go down to it
            edges.append(np.stack([found, child]))
            rest = np.ones(len(below), bool)
            rest[at] = False
            parent, below = child[inverse][rest], below[rest]
        table = np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.int64)
        order = np.argsort(table[0], kind="stable")
        self.edge, self.child = table[0][order], table[1][order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs at most ``radius`` apart, by level; both are numbers of values."""
        node = self.root[queries]
        while len(queries):
            apart = np.bitwise_count(self.values[queries] ^ self.values[node]).astype(np.int64)
            near = apart <= radius
            yield queries[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(apart - radius, 0))
            count = np.searchsorted(self.edge, node * 65 + np.minimum(apart + radius, 64), "right") - low
            queries = np.repeat(queries, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            node = self.child[at]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels in which linked numbers have one label, the smallest number of theirs."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            after = labels[labels]
            if np.array_equal(after, labels):
                break
            labels = after


def _searched(values: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of the shards' members, for about a million visits at a time."""
    forest = BKForest(values, shard)
    visits = np.cumsum(np.minimum(np.bincount(shard)[shard], 4096))
    for part in np.split(np.arange(len(values)), np.searchsorted(visits, np.arange(1_000_000, visits[-1], 1_000_000))):
        found = list(forest.within(part, radius))
        yield np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def shard_links(values: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (number of a member, that of the first linked one): stars that connect all within the radius."""
    labels = np.arange(len(values))
    for query, node in _searched(values, shard, radius):
        labels = joined(labels, query, node)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return moved, labels[moved]


def verified_links(shingles: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of members (sets of ``sizes`` shingles each, one after the other), equal where links of the similarity connect.

    Two sets of the similarity share one of the rarest shingles of each, as all but ``similarity`` of a set is among them.
    Each member is compared with all later ones that share such a shingle, or with all if those are fewer shingles; left
    out are only those that verified links have already connected with it.
    """
    n = len(sizes)
    labels = np.arange(n)
    owner = np.repeat(labels, sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    _, token, often = np.unique(shingles, return_inverse=True, return_counts=True)
    order = np.lexsort((token, often[token], owner))
    rare = np.arange(len(order)) - first[owner] <= sizes[owner] - np.ceil(similarity * sizes - 1e-9)[owner]
    rare &= often[token[order]] > 1
    prefix, holder = token[order][rare], owner[rare]
    starts = np.searchsorted(holder, np.arange(n + 1))
    by_token = np.argsort(prefix, kind="stable")
    listed, posting = prefix[by_token], holder[by_token]
    low, high = np.searchsorted(listed, prefix), np.searchsorted(listed, prefix, "right")
    mark = np.zeros(len(often), bool)
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        mine = slice(starts[i], starts[i + 1])
        if (high[mine] - low[mine]).sum() < sizes[others].sum():
            sharing = np.zeros(n, bool)
            for l, h in zip(low[mine].tolist(), high[mine].tolist(), strict=True):
                sharing[posting[l:h]] = True
            others = others[sharing[others]]
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9]
        others = others[sizes[others] > 0]
        if not len(others):
            continue
        own = token[first[i] : first[i + 1]]
        mark[own] = True
        good = []
        for part in np.split(others, np.searchsorted(np.cumsum(sizes[others]), np.arange(_BLOCK, sizes[others].sum(), _BLOCK))):
            if not len(part):
                continue
            count = sizes[part]
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(first[part] - ends + count, count)
            both = np.add.reduceat(mark[token[at]], ends - count, dtype=np.int64)
            good.append(part[both / (count + sizes[i] - both) >= similarity])
        mark[own] = False
        near = np.concatenate(good)
        if len(near):
            met = np.zeros(n, bool)
            met[labels[near]] = met[labels[i]] = True
            labels[met[labels]] = np.flatnonzero(met)[0]
    return labels


def _in_shards(rows: DataFrame, limit: int, build) -> DataFrame:
    """(a, b), nodes, of ``build(values, shard)`` on the shards of ``rows`` (node, value, choice, bits) with several members."""
    large = written(rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).withColumn("groups", F.ceil(F.col("n") * 2 / limit).cast("int")).drop("n"), "shards")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("value"), F.col("groups")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.least(g, own) * 65536 + F.greatest(g, own))
        rows = rows.join(large, ["choice", "bits"], "left").withColumn("cell", F.explode(F.when(F.col("groups").isNull(), F.array(F.lit(0))).otherwise(cells))).drop("groups")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    rows = rows.repartition("choice", "bits", "cell").sortWithinPartitions("choice", "bits", "cell", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n = 0

        def done(table: np.ndarray) -> pa.RecordBatch:
            node, table = table[:, 4], table[:, :4]
            shard = np.cumsum(np.concatenate(([False], (table[1:, 1:] != table[:-1, 1:]).any(1))))
            several = np.bincount(shard)[shard] > 1
            a = b = np.zeros(0, np.int64)
            if several.any():
                _, shard = np.unique(shard[several], return_inverse=True)
                i, j = build(np.ascontiguousarray(table[several, 0]).view(np.uint64), shard)
                a, b = node[several][i], node[several][j]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("value", "choice", "bits", "cell", "node")], 1))
            held_n += batch.num_rows
            if held_n < 200_000:
                continue
            table = np.concatenate(held)
            starts = np.flatnonzero((table[1:, 1:4] != table[:-1, 1:4]).any(1)) + 1
            cut = starts[-1] if len(starts) else 0  # the last shard may go on in the next batch
            if cut:
                yield done(table[:cut])
            held, held_n = [table[cut:]], len(table) - cut
        if held:
            yield done(np.concatenate(held))

    return rows.select("value", "choice", "bits", "cell", "node").mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shared: int = SHARED, limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b): links between ``nodes`` (node, fingerprint) whose components are those of all pairs within the radius."""
    if radius > blocks - shared:
        raise ValueError("too few blocks for the radius")
    masks = block_masks(blocks, shared)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
    rows = nodes.select("node", F.col("fingerprint").alias("value"), F.explode(keys).alias("key")).select("node", "value", "key.choice", "key.bits")
    return _in_shards(rows, limit, lambda values, shard: shard_links(values, shard, radius))


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float, words: int, small: int = SMALL, limit: int = SHARD_SHINGLES) -> DataFrame:
    """(a, b): links between nodes whose components are those of all pairs of a shard that reach the similarity.

    ``nodes``: node and bands; ``texts``: node and text, one row each.
    """
    rows = nodes.select("node", F.posexplode("bands").alias("choice", "bits")).where("bits is not null")
    several = rows.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(rows.join(several, ["choice", "bits"]), "members")
    pair = "explode(flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> struct(x as a, y as b)))))"
    pairs = members.where(F.col("n") <= small).groupBy("choice", "bits").agg(F.array_sort(F.collect_list("node")).alias("v")).select(F.expr(pair).alias("pair")).select("pair.*").distinct()
    pairs = written(pairs, "kin")
    named = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "a_text"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "b_text"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in chunks(batch, "a_text", 1 << 20):
                for part in chunks(half, "b_text", 1 << 20):
                    near = pa.array(jaccard(part.column("a_text"), part.column("b_text"), words) >= similarity)
                    yield part.select(["a", "b"]).filter(near)

    out = named.mapInArrow(run, "a long, b long")
    large = members.where(F.col("n") > small)
    if not large.isEmpty():
        out = out.unionByName(_large_links(large, texts, similarity, words, limit))
    return out.distinct()


def _large_links(members: DataFrame, texts: DataFrame, similarity: float, words: int, limit: int) -> DataFrame:
    """(a, b) of shards (node, choice, bits) whose members' sets of shingles go to the shard and are compared there."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                found = Shingles(part.column("text"), words, lower=True)
                each = [np.unique(found.value[a:b]) for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
                ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                flat = pa.array(np.concatenate(each).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(np.diff(ends).astype(np.int64))], names=["node", "shingles", "size"])

    held = written(texts.join(members.select("node").distinct(), "node").select("node", "text").mapInArrow(sets, "node long, shingles array<long>, size long"), "shingles")
    sized = members.select("node", "choice", "bits").join(held.select("node", "size"), "node")
    groups = sized.groupBy("choice", "bits").agg(F.sum("size").alias("all")).select("choice", "bits", F.when(F.col("all") <= limit, 1).otherwise(F.ceil(F.col("all") * 2 / limit)).cast("int").alias("groups"))
    groups = written(groups, "groups")  # so that Spark knows its size and does not deal the members by shard to join it
    own = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.least(g, own).cast("long") * (1 << 31) + F.greatest(g, own))
    rows = members.select("node", "choice", "bits").join(groups, ["choice", "bits"]).select("node", "choice", "bits", F.explode(cells).alias("cell")).join(held, "node")
    rows = rows.repartition("choice", "bits", "cell").sortWithinPartitions("choice", "bits", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        values: list[np.ndarray] = []
        lists: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            value = np.concatenate(values)
            labels = verified_links(np.concatenate(lists), np.concatenate(sizes), similarity)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            values.clear(), lists.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(value[moved]), pa.array(value[labels[moved]])], names=["a", "b"])

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "bits", "cell")], 1)
            edges = np.concatenate(([0], np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1, [len(table)])) if len(table) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if values and key != tuple(table[a]):
                    yield done()
                key = tuple(table[a])
                part = batch.slice(a, b - a)
                values.append(part.column("node").to_numpy(zero_copy_only=False))
                lists.append(part.column("shingles").flatten().to_numpy(zero_copy_only=False).copy())
                sizes.append(part.column("size").to_numpy(zero_copy_only=False))
        if values:
            yield done()
        tidy()

    return rows.select("node", "choice", "bits", "cell", "shingles", "size").mapInArrow(run, "a long, b long")


def jaccard(a: pa.Array, b: pa.Array, words: int) -> np.ndarray:
    """The similarity of each pair's sets of shingles, in which A-Z are lowered as in fingerprints; 0 if both are empty."""
    n = len(a)
    sets = []
    for column in (a, b):
        found = Shingles(column, words, lower=True)
        own = found.owner()
        key, at = np.unique(mixed(found.value + mixed(own.astype(np.uint64) + np.uint64(1))), return_index=True)
        sets.append((key, own[at]))
    (x, own), (y, other) = sets
    both = np.bincount(own[np.isin(x, y, assume_unique=True)], minlength=n)
    either = np.bincount(own, minlength=n) + np.bincount(other, minlength=n) - both
    return both / np.maximum(either, 1)


def components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, seed: int = SEED, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): of each row of ``df`` the smallest id that its fingerprint reaches.

    With a ``similarity``, texts whose shingles reach it are linked as well.
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    bands = None if similarity is None else "bands"
    rows = written(fingerprints(texts, words=words, seed=seed, bands=bands), "fingerprints")
    name = F.coalesce("first_id", F.lit(NAMELESS).bitwiseOR(F.col("fingerprint").bitwiseAND(F.lit(NAMELESS - 1))))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("bands")) if bands else None
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *([F.min_by("bands", first).alias("bands")] if bands else [])).withColumn("node", name)
    nodes = written(nodes, "nodes")
    edges = links(nodes.select("node", "fingerprint"), radius=radius)
    if similarity is not None:
        # a node's name is the id of its first text
        named = texts.where("doc_id is not null").withColumnRenamed("doc_id", "node")
        if not rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            named = named.groupBy("node").agg(F.min("text").alias("text"))
        edges = edges.unionByName(similar_links(nodes.where("first_id is not null").select("node", "bands"), named, similarity, words))
    linked = connected_components(edges)
    of_node = nodes.select("node", "fingerprint", "n").join(linked, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"), "n")
    of_node = written(of_node.withColumn("component_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id"))), "components")
    return join_skewed(rows.select("doc_id", "fingerprint"), of_node, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(fingerprint: Column) -> Column:
    """Sixteen lowercase digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def first_of_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``df`` with one row of each component: the one with the smallest id, of rows that repeat it the least by its columns.

    Columns that have no order (maps) do not count in that.  Rows without an id are not judged and stay.
    """
    kept = components(df, text, doc_id, **options).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = df.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id) == F.col("__kept"), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    ordered = [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    least = F.min(whole) if len(ordered) == len(df.columns) else F.min_by(whole, F.struct(*(F.col(f"`{c}`") for c in ordered)))
    named = named.groupBy(F.col(doc_id).alias("__id")).agg(least.alias("__row")).select("__row.*")
    return named.unionByName(df.where(F.col(doc_id).isNull()))
