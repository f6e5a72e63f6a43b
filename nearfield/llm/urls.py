"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

One automaton holds strict and soft terms.  A hit counts only if it is not part of a longer run of letters or digits, so
``bet`` in ``alphabet`` is none.  One strict hit rejects, and so do soft hits whose different stems weigh ``soft_limit`` or
more together: the forms of a stem (``deal``, ``deals``) and a repeated form are one hit.  A vocabulary is a list of terms,
built in or read from a table or file of (kind, stem, form, weight).  Rules come first: a rule names a host and a path
prefix, fits that host and all its subdomains, and the longest that fits decides; of equals the first given.

Null or malformed urls have an empty host and path; null ones have no terms and are allowed.  Urls of any length are
searched whole.  Repeated rows give repeated results; an empty table gives an empty result; other columns are carried as
they are, and those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks


class Term(NamedTuple):
    """A form that is searched for, the stem that it counts for, and the stem's weight; a strict one rejects alone."""

    form: str
    stem: str
    weight: int = 1
    strict: bool = False


SOFT_LIMIT = 2
_STRICT = "adult casino escort gambling hentai lottery malware phishing poker porn sex spam torrent viagra warez webcam xxx"
_SOFT = "ad/ads bet/bets/betting bonus/bonuses cheap click crack/cracked deal/deals farm free hot keygen loan/loans pill/pills pharmacy promo/promos slot/slots track/tracker/tracking win/winner/winners"
VOCABULARY: tuple[Term, ...] = (
    *(Term(form, form, strict=True) for form in _STRICT.split()),
    *(Term(form, forms.split("/")[0]) for forms in _SOFT.split() for form in forms.split("/")),
)


def vocabulary_of(rows: DataFrame) -> tuple[Term, ...]:
    """Terms of a table (kind: strict or soft, stem, form, weight), such as a CSV file read by Spark.

    Forms are lower-cased, null or empty ones left out, a null stem is the form, a null weight 1.  A stem has the greatest
    of its weights, and a form that is given as strict and soft is strict.  The list goes to every task, so it must be one
    that a person or a small job made: more than 100,000 terms are an error.
    """
    found = rows.select(F.lower("kind"), F.lower("stem"), F.lower("form"), F.col("weight").cast("int")).where("coalesce(form, '') <> ''").limit(100_001).collect()
    if len(found) > 100_000:
        raise ValueError("more than 100,000 terms")
    weights: dict[str, int] = {}
    for _, stem, form, weight in found:
        weights[stem or form] = max(weights.get(stem or form, 0), 1 if weight is None else weight)
    terms: dict[str, Term] = {}
    for kind, stem, form, _ in sorted(found, key=lambda r: (r[0] == "strict", r[2], r[1] or "")):
        if kind not in ("strict", "soft"):
            raise ValueError(f"kind {kind!r} of {form!r}")
        terms[form] = Term(form, stem or form, weights[stem or form], kind == "strict")
    return tuple(terms.values())


#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.  Rules of one length: the first given."""
    rule = verdict = None
    for kind, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    empty = F.lit(None).cast("string")
    return (empty, empty) if rule is None else (rule, verdict)


def automaton(vocabulary: tuple[Term, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in vocabulary:
        found.add_word(term.form, term)
    if vocabulary:
        found.make_automaton()
    return found


def term_hits(url: str | None, found) -> tuple[list[str], list[str], int]:
    """The different strict forms and soft stems of one url, sorted, and the weight of those stems."""
    text = (url or "").translate(_ASCII_LOWER)
    strict: set[str] = set()
    soft: dict[str, int] = {}
    for end, term in found.iter(text) if len(found) else ():
        start = end - len(term.form) + 1
        if (start == 0 or text[start - 1] not in _INSIDE) and (end + 1 == len(text) or text[end + 1] not in _INSIDE):
            if term.strict:
                strict.add(term.form)
            else:
                soft[term.stem] = term.weight
    return sorted(strict), sorted(soft), sum(soft.values())


_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_INSIDE = frozenset(LOWER + "0123456789")


def filter_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: tuple[Term, ...] = VOCABULARY, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``df`` with host, path, strict_terms, soft_terms (stems), soft_weight, rule and verdict; own columns of those names are replaced."""
    added = ("host", "path", "strict_terms", "soft_terms", "soft_weight", "rule", "verdict")
    kept = [f for f in df.schema.fields if f.name not in added]
    words = T.ArrayType(T.StringType(), False)
    schema = T.StructType([*kept, T.StructField("strict_terms", words), T.StructField("soft_terms", words), T.StructField("soft_weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(vocabulary)
        for batch in batches:
            for part in chunks(batch, url):
                hits = [term_hits(u, found) for u in part.column(url).to_pylist()]
                new = [pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], names=schema.names)

    out = df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
    out = out.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rejected = (F.size("strict_terms") > 0) | (F.col("soft_weight") >= soft_limit)
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")))


def oracle_sql(rules: tuple[Rule, ...] = RULES, vocabulary: tuple[Term, ...] = VOCABULARY, soft_limit: int = SOFT_LIMIT) -> str:
    """The same verdicts with regular expressions instead of the automaton."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", k, h + p) for k, h, p in ordered]
    hit = lambda forms: f"regexp_matches(low, '(^|[^a-z0-9])({'|'.join(forms)})($|[^a-z0-9])')"
    soft: dict[tuple[str, int], list[str]] = {}
    for t in vocabulary:
        if not t.strict:
            soft.setdefault((t.stem, t.weight), []).append(t.form)
    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low
  FROM pages),
ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, _, r in fits)} END AS rule,
    CASE {' '.join(f"WHEN {f} THEN '{k}'" for f, k, _ in fits)} END AS ruled,
    {hit([t.form for t in vocabulary if t.strict])} AS strict_hit,
    ({' + '.join(f'{w} * {hit(forms)}::INT' for (_, w), forms in soft.items())}) AS n_soft
  FROM parts)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN strict_hit OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
