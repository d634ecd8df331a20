"""URL filters: host rules first, then a weighted vocabulary found by Aho-Corasick.

The vocabulary has strict and soft terms. One automaton finds all of them in the
lower-cased host and path in one pass; an occurrence counts only between
boundaries, where no letter or digit touches it. A url with one strict hit, or
with several distinct soft terms, is blocked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default vocabulary: parameters, not fixed values.
STRICT = ("adult", "casino", "escort", "hardcore", "hentai", "malware", "nude", "phishing", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("bet", "bets", "bingo", "bonus", "cam", "cams", "cheap", "crack", "dating", "free", "gambling", "girls", "hot", "jackpot", "loan", "loans", "lottery", "pills", "poker", "prize", "slots", "torrent", "win")
SOFT_HITS = 2
#: The rules of the contract, as verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = None
    for said, domain, start in longest:
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule = F.when(fits, domain + start) if rule is None else rule.when(fits, domain + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def automaton(strict: Sequence[str], soft: Sequence[str]):
    """The Aho-Corasick automaton, and what kind each term is."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term.lower(), (term.lower(), kind))
    found.make_automaton()
    return found


def _touches(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(found, text: str) -> tuple[int, int]:
    """Strict hits and distinct soft terms of a text already lower-cased."""
    strict, soft = 0, set()
    for last, (term, kind) in found.iter(text):
        first = last - len(term) + 1
        if (first and _touches(text[first - 1])) or (last + 1 < len(text) and _touches(text[last + 1])):
            continue
        if kind == "strict":
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS,
    url: str = "url",
    key: str = "page_id",
) -> DataFrame:
    """key, url, host, path, rule, verdict, strict_hits and soft_hits (distinct terms) of every row.

    A null url, or one without ``://``, has an empty host and path, so no rule
    fits it and it is allowed. Repeated rows are judged alike; rules of equal
    length are ordered by verdict, so allow wins; extra columns are left out; an
    empty table gives no rows.
    """
    host, path = split(url)
    kind = dict(pages.dtypes)[key]
    parts = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    schema = f"key {kind}, url string, host string, path string, strict_hits int, soft_hits int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            texts = pc.binary_join_element_wise(batch.column("host"), batch.column("path"), "").to_pylist()
            pairs = [hits(terms, text.lower()) for text in texts]
            counts = [pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], ["key", "url", "host", "path", "strict_hits", "soft_hits"])

    found = parts.mapInArrow(run, schema)
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits), "block").otherwise("allow")
    return found.select(
        F.col("key").alias(key), "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits"
    )


def sql() -> str:
    """DuckDB SQL of the query: boundaries as a regular expression for each term."""

    def count(terms: Sequence[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(t, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INT)" for term in terms)

    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(f"((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}'))", d + p, v) for v, d, p in longest]
    rule = " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits)
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), texts AS (SELECT *, lower(host || path) AS t FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {said} WHEN {count(STRICT)} > 0 OR {count(SOFT)} >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM texts"""
