"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a linear function of features of its text: rates of symbols, repeats, capitals, digits and the like,
and how often its lower-cased words and word pairs fall into each of ``HASHED`` buckets of a hash.  Preference pairs (a good
document, a bad one) are drawn from labelled rows, and the weights are learned by logistic loss on the difference of their
features: the chance that the good one is preferred is the logistic function of the scores' difference.  The cut-off is a
quantile of the labelled scores, namely the share of bad labels; the published score maps that quantile to ``THRESHOLD``.

Training reads at most ``MOST_LABELLED`` labelled ids (those with the lowest hash, so reruns agree) and is the only bounded
part: every row is scored on its whole text.  An id that is labelled twice counts with its greater label, and of rows that
repeat a labelled id the one with the least features.  Null and empty texts score as texts without words.  Where one label is
missing the score is constant.  Texts of any length are read whole.  Equal texts, ties and repeated rows score alike; an
empty table gives an empty result; a column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, mixed, utf8_column

MOST_LABELLED = 20_000
PAIRS = 40_000
THRESHOLD = 0.7
STEPS, SEED = 100, 17
#: The ridge on the rates and on the buckets.
PENALTY, HASHED_PENALTY = 1e-3, 3e-2

FEATURES = ("symbols", "doubled", "upper", "exclaim", "digits", "different", "long_words", "short", "dup_neighbours_2")
#: Buckets of words and word pairs.
HASHED = 256
WIDTH = len(FEATURES) + HASHED
_BLOCK = 8192
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def text_features(column: pa.Array) -> np.ndarray:
    """(n, WIDTH): rates of each text and its share of words and pairs by bucket; nothing but the text is looked at."""
    words = Words(column, lower=True)
    raw, _ = utf8_column(column)
    n = len(column)
    counts = words.counts
    size = np.maximum(counts, 1).astype(float)
    n_bytes = np.diff(words.offsets)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[words.offsets[1:]] - total[words.offsets[:-1]]).astype(float)

    def words_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[words.first[1:]] - total[words.first[:-1]]).astype(float)

    hashed = words.hashes()
    owner = words.text_of_word()
    neighbour = [np.zeros(len(hashed), bool), np.zeros(len(hashed), bool)]
    for k in (1, 2):
        if len(hashed) > k:
            neighbour[k - 1][k:] = (hashed[k:] == hashed[:-k]) & (owner[k:] == owner[:-k])
    order = np.lexsort((hashed, owner))
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    different = np.bincount(owner, fresh, n)
    letters = np.maximum(n_bytes, 1)
    columns = [
        np.log1p(4 * bytes_in(_SYMBOL[raw]) / size),
        words_in(neighbour[0]) / size,
        bytes_in(_UPPER[raw]) / letters,
        np.log1p(4 * bytes_in(raw == 33) / size),
        bytes_in(_DIGIT[raw]) / letters,
        np.log((different + 1) / (size + 1)) + 0.12 * np.log1p(size),  # vocabulary grows more slowly than the text
        words_in(words.ends - words.starts > 30) / size,
        (counts < 5).astype(float),
        words_in(neighbour[1]) / size,
    ]
    if not n:
        return np.zeros((0, WIDTH))
    with np.errstate(over="ignore"):
        pairs = mixed(hashed[:-1] * np.uint64(3) + hashed[1:])
    together = owner[1:] == owner[:-1]
    buckets = np.concatenate((hashed, pairs[together])) % np.uint64(HASHED)
    place = np.concatenate((owner, owner[1:][together])) * HASHED + buckets.astype(np.int64)
    shares = np.bincount(place, minlength=n * HASHED).reshape(n, HASHED) / size[:, None]
    return np.concatenate((np.stack(columns, 1), shares), 1)


class PairwiseRanker:
    """Weights, and the line from a raw score to a published one."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, seed: int = SEED):
        self.weights, self.scale, self.cut, self.slope = np.zeros(WIDTH), np.ones(WIDTH), 0.0, 0.0
        self.penalty = np.concatenate((np.full(len(FEATURES), PENALTY), np.full(HASHED, HASHED_PENALTY)))
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        if not len(good) or not len(bad):
            return
        self.scale = features.std(0) + 1e-6
        scaled = features / self.scale
        draw = np.random.default_rng(seed)
        self.good, self.bad = draw.choice(good, pairs), draw.choice(bad, pairs)
        for _ in range(STEPS):  # Newton's method, with steps of bounded length
            _, gradient, curve = self.loss(scaled, self.weights)
            move = np.linalg.solve(curve, gradient)
            self.weights = self.weights - move / max(1.0, np.abs(move).max())
            if np.abs(move).max() < 1e-9:
                break
        raw = np.sort(scaled @ self.weights)
        # the quantile at the share of bad labels, midway between its neighbours
        k = min(max(len(bad), 1), len(raw) - 1)
        self.cut = float((raw[k - 1] + raw[k]) / 2)
        self.slope = 1.0

    def __getstate__(self) -> dict:
        """Without the pairs, which scoring does not need."""
        return {k: v for k, v in self.__dict__.items() if k not in ("good", "bad", "penalty")}

    def loss(self, scaled: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean logistic loss of the pairs with the ridge, its gradient and its second derivatives."""
        total, gradient, curve = 0.0, self.penalty * weights, np.diag(self.penalty)
        n = len(self.good)
        for at in range(0, n, _BLOCK):
            difference = scaled[self.good[at : at + _BLOCK]] - scaled[self.bad[at : at + _BLOCK]]
            margin = difference @ weights
            wrong = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
            total += float(np.logaddexp(0, -margin).sum()) / n
            gradient = gradient - difference.T @ wrong / n
            curve = curve + (difference * (wrong * (1 - wrong) / n)[:, None]).T @ difference
        return total + float(self.penalty @ weights**2) / 2, gradient, curve

    def score(self, features: np.ndarray) -> np.ndarray:
        raw = (features / self.scale) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + np.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def labelled_features(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents, on the driver."""
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    wanted = wanted.orderBy(F.xxhash64(doc_id), doc_id).limit(most)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted.select(F.col(doc_id).alias("id"), "label")), "id")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x = text_features(part.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), flat], names=schema.names)

    rows = texts.select("id", "label", "text").mapInArrow(run, schema).groupBy("id", "label").agg(F.min("x").alias("x"))  # at most ``most``
    found = rows.toArrow().combine_chunks().sort_by("id")
    return np.asarray(found["x"].combine_chunks().flatten(), float).reshape(-1, WIDTH), found["label"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, **options) -> PairwiseRanker:
    return PairwiseRanker(*labelled_features(docs, labels, **options))


def score(df: DataFrame, model: PairwiseRanker, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with a score of each whole text; one pass without a shuffle."""
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                scores = model.score(text_features(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(scores)], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
