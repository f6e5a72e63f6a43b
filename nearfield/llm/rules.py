"""Host-level quality rules, natively in DataFrame functions.

Each document gets four counts and a base verdict; failures are added up by host, each host's failure rate is drawn
towards the corpus by a beta prior fitted to all hosts (method of moments), and the host's verdict is joined back.  A host
goes, with all its documents, if its shrunk rate is above a limit that the prior gives: ``SPREADS`` of the prior's standard
deviations above its mean, midway between its mean and one at most where hosts differ very much, and half at least, so that
clean documents never go with a host that is merely worse than others.

Null texts have no words and fail.  A null host is a host of its own.  Empty texts have no words; texts of any length
are counted whole, in time n log n; repeated rows count each time; a rate equal to the limit stays; an empty table gives an
empty result; columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
#: A host goes if its shrunk failure rate is above the prior's mean by so many standard deviations, and above this rate.
SPREADS, HOST_LEAST = 2.0, 0.5


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the text, the first included.

    Window hashes are sorted with their positions only in texts whose windows are not all different.
    """

    def repeated(hashes: Column) -> Column:
        def covered(pairs: Column) -> Column:
            same = lambda i: pairs[i]["h"]
            last = F.size(pairs) - 1
            hits = F.filter(
                F.transform(pairs, lambda p, i: F.when(((i > 0) & (same(F.greatest(i - 1, F.lit(0))) == p["h"])) | ((i < last) & (same(F.least(i + 1, last)) == p["h"])), p["i"])),
                lambda p: p.isNotNull(),
            )
            start = F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(F.array_sort(hits), start, lambda s, p: F.struct(p.alias("p"), (s["n"] + F.least(F.lit(WINDOW), p - s["p"])).alias("n")), lambda s: s["n"])

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bound(pairs, covered))

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(each) - WINDOW), lambda i: F.xxhash64(*[each[i + k] for k in range(WINDOW)]))

    # a word is hashed once, not once a window
    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_bound(_bound(each, windows), repeated))


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # only the first and the last part can be empty
    found = F.split(body, r"[\x20\x09-\x0D]+", -1)
    empty = lambda at: (F.element_at(found, at) == "").cast("int")
    out = df.withColumn("__found", found)
    found = F.col("__found")
    out = out.withColumn("__words", F.slice(found, 1 + empty(1), F.greatest(F.size(found) - empty(1) - empty(-1), F.lit(0)))).drop("__found")
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"))
    out = out.withColumn("n_dup_lines", _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = out.withColumn("n_repeat_words", repeat_words(F.col("__words"))).drop("__words")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(failures: DataFrame, host: str = "host", spreads: float = SPREADS, least: float = HOST_LEAST) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_limit, host_kept) from rows of (host, base_failed).

    The prior beta(a, b) has the mean and variance of the hosts' rates; where the variance leaves no prior (one host, or
    none that differs), a + b is the mean number of documents of a host.
    """
    by_host = failures.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = by_host.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg("n_docs").alias("mean_docs"))
    spread = F.col("m") * (1 - F.col("m"))
    strength = F.when((F.col("v") > 0) & (F.col("v") < spread), spread / F.nullif(F.col("v"), F.lit(0.0)) - 1).otherwise(F.col("mean_docs"))
    out = by_host.withColumn("prior", prior.select(F.struct(F.col("m"), strength.alias("s"))).scalar())
    m, s = F.col("prior.m"), F.col("prior.s")
    shrunk = (F.col("n_failed") + m * s) / (F.col("n_docs") + s)
    limit = F.greatest(F.lit(least), F.least(m + spreads * F.sqrt(m * (1 - m) / (s + 1)), (1 + m) / 2))
    return out.select(host, "n_docs", "n_failed", shrunk.alias("shrunk_rate"), limit.alias("host_limit"), (shrunk <= limit).alias("host_kept"))


def judge(df: DataFrame, text: str = "text", host: str = "source", spreads: float = SPREADS, least: float = HOST_LEAST) -> DataFrame:
    """``df``'s columns but the text, the counts, base_failed, shrunk_rate and kept.

    The texts are read once and not shuffled: the counts alone go to the join.  The host table is broadcast only where
    its size is under Spark's limit; beyond it Spark splits a hot host's join.
    """
    rows = written(counted(df.drop("shrunk_rate", "host_kept"), text).drop(text), "counts")
    hosts = written(host_verdicts(rows.select(F.col(host).alias("host"), "base_failed"), spreads=spreads, least=least), "hosts")
    out = rows.join(hosts.select(F.col("host").alias("__host"), "shrunk_rate", "host_kept"), F.col(host).eqNullSafe(F.col("__host")), "left")
    return out.drop("__host").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).drop("host_kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
grams AS (SELECT doc_id, words, list_transform(range(0, len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) AS g
  FROM w WHERE len(words) >= 5),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(g) AS x, unnest(range(0, len(g))) AS i FROM grams)
  QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(n) AS d FROM h),
q AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE d END AS s FROM p),
k AS (SELECT source, (f + m * s) / (n + s) <= greatest(0.5, least(m + 2 * sqrt(m * (1 - m) / (s + 1)), (1 + m) / 2)) AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_kept AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source"""
