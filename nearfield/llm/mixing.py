"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size.  The documents of a source are
put in order of size, their expected copies are summed up from the start, one random offset is added, and a document is
emitted once for each integer boundary that its step crosses.  As neighbours in the order have nearly one size, the words
taken come near the target.

Prefix sums need only a document's rank, which is found without one task holding a source: counts by (source, size) and
by (source, size, slot) are added up, and rows are numbered within a slot.  Offsets and slots derive from hashes, so
reruns agree.

Null texts have size 0 and are emitted or not like other small documents, taking no words.  A null source is a source of
its own, and the last.  A source without words has target 0.  Repeated rows count each time (their copies depend on the
order among equals, their sum does not).  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: A source's target is at most this many times its size.
LIMIT = 2
SLOTS = 1024


def sizes(text: Column) -> Column:
    """Number of words."""
    found = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return (F.size(found) - (found[0] == "").cast("int") - ((F.size(found) > 1) & (F.element_at(found, -1) == "")).cast("int")).cast("long")


def targets(by_source: DataFrame, share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_key, source_size, target) of one row per source (source_key, source_size).

    Targets are in proportion to the weights up to ``limit`` times the size; what a source can't take goes to the others
    by weight.  That is the level L with sum(min(limit * size, weight * L)) = share * total.  With the sources in order
    of limit * size / weight, L is the highest of the levels at which the first k sources are full and the rest share
    evenly.  The table has a row per source, so one task orders it.
    """
    by_key = Window.orderBy("source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * limit)
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_key").asc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", F.max((F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("full")) / F.col("open")).over(whole))
    )
    return rows.select("source_key", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def source_key(source: Column) -> Column:
    """Never null, and in order of the code points with the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def offset(key: Column) -> Column:
    """In [0, 1), a multiple of 1/65536, from the source."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("double") / 65536


def slot(doc_id: Column) -> Column:
    return F.pmod(F.coalesce(doc_id, F.lit(0)) * 40503, F.lit(SLOTS))


def systematic(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``df``'s columns with size, source_size, target and copies; own columns of those names are replaced.

    Rows move once, by (source, size, slot), with the columns that the caller goes on to use.
    """
    names = ["size", "source_size", "target", "copies"]
    rows = df.drop(*names).withColumn("size", sizes(F.col(text))).withColumn("__key", source_key(F.col(source))).withColumn("__slot", slot(F.col(doc_id)))
    keys = ["__key", "size", "__slot"]
    by_slot = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "slots")
    by_size = by_slot.groupBy("__key", "size").agg(F.sum("n").alias("n"))
    goals = targets(by_size.groupBy(F.col("__key").alias("source_key")).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), share, limit, weights)
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = by_size.withColumn("smaller", earlier(["__key"], "size")).drop("n")
    by_slot = by_slot.withColumn("earlier", earlier(["__key", "size"], "__slot")).drop("n")
    starts = written(by_slot.join(by_size, ["__key", "size"]).join(goals.withColumnRenamed("source_key", "__key"), "__key").select(*keys, (F.col("smaller") + F.col("earlier")).alias("__base"), "source_size", "target"), "starts")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(doc_id)))
    out = ranked.join(starts, keys)
    step = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    place = F.col("__base") + F.col("__rank")
    reached = lambda r: F.floor(r * step + offset(F.col("__key")))
    copies = F.least(reached(place) - reached(place - 1), F.lit(limit)).cast("int")
    return out.withColumn("copies", copies).select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *names)


def emit(df: DataFrame) -> DataFrame:
    """Each row of ``systematic``'s result as many times as it has copies, without the columns that were added."""
    out = df.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("copies"))))
    return out.drop("__copy", "size", "source_size", "target", "copies")


ORACLE = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0.0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0) AS open,
    sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM w WINDOW o AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(cap, max((total - used) / open) OVER () * weight)::DOUBLE AS target FROM f),
r AS (SELECT d.*, source_size, target, coalesce(target / nullif(source_size::DOUBLE, 0), 0) AS step,
    row_number() OVER (PARTITION BY d.k ORDER BY size, (coalesce(doc_id, 0) * 40503) % {SLOTS}, doc_id) AS place,
    ('0x' || substr(md5(d.k), 1, 4))::INT / 65536.0::DOUBLE AS u
  FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, source_size, target,
  (least(floor(place * step + u) - floor((place - 1) * step + u), 2) * size)::BIGINT AS taken
FROM r"""
