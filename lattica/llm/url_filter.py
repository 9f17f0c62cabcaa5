"""Operator 1: URL filters by a bit-parallel wildcard automaton.

All glob rules together are one bit vector of pattern positions, packed in 64-bit words. Reading one
byte of a URL shifts the vector by one, lets positions behind a ``*`` stay, and masks it with the
positions that accept the byte, so every rule advances at once. The URLs of a batch are stepped
together, longest first, so that each step is a few numpy operations over all that still have bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.runtime import ship


@dataclass(frozen=True)
class Rule:
    rule_id: int
    action: str  # "block" or "allow"
    glob: str  # * any bytes, ? one byte


_SPAM = "casino bets poker jackpot slots lottery pills viagra cialis loans payday forex crypto-win adult xxx porn escort dating warez torrent crack keygen serial cheap-watch replica miracle weight-loss".split()
_TRACK = "click track redirect affiliate adserver doubleclick banner popunder pixel beacon".split()
_FILES = "exe zip rar 7z dmg iso apk msi jpg jpeg png gif webp svg ico mp3 mp4 avi mov woff css js".split()

#: The rules that the query runs with; ``allow`` wins over ``block``.
RULES = tuple(
    Rule(i, action, glob)
    for i, (action, glob) in enumerate(
        [("block", f"*://*{w}*/*") for w in _SPAM]
        + [("block", f"*://{w}.*/*") for w in _TRACK]
        + [("block", f"*://*/*/{w}/*") for w in _TRACK]
        + [("block", f"*.{w}") for w in _FILES]
        + [("block", g) for g in ("*://*/login*", "*://*/cart/*", "*://*/wp-admin/*", "*://*/tag/*/page/*", "*://*.example.net/fr/9???*", "*://m.*/*/?", "*?page=*", "*&sort=*")]
        + [("allow", g) for g in ("https://*.example.org/*", "*://blog.*.example.com/en/*", "*://*.edu/*", "*://*.gov/*", "http*://casino-history.example.com/*")]
    )
)


class Automaton:
    """Masks of all rules; rule k accepts where its last position is set after the last byte."""

    def __init__(self, globs: list[str]):
        cells: list[int] = []  # byte, or -1 for ?
        stay: list[bool] = []  # a * follows this position
        first: list[int] = []
        self.last: list[int] = []  # -1: nothing but stars, accepts all; -2: empty, accepts the empty URL
        begins: list[int] = []
        floats: list[int] = []  # first positions behind a leading *
        for glob in globs:
            raw = glob.encode()
            lead = raw.startswith(b"*")
            start = len(cells)
            for byte in raw:
                if byte == 42:
                    if len(cells) > start:
                        stay[-1] = True
                else:
                    cells.append(-1 if byte == 63 else byte)
                    stay.append(False)
            if len(cells) == start:
                self.last.append(-1 if lead else -2)
                continue
            first.append(start)
            (floats if lead else begins).append(start)
            self.last.append(len(cells) - 1)
        self.words = max(1, -(-len(cells) // 64))
        self.accept = np.zeros((256, self.words), np.uint64)
        for i, cell in enumerate(cells):
            rows = slice(None) if cell < 0 else cell
            self.accept[rows, i // 64] |= np.uint64(1 << (i % 64))
        self.stay, self.inner = self._mask([i for i, s in enumerate(stay) if s]), ~self._mask(first)
        self.begin, self.float = self._mask(begins + floats), self._mask(floats)

    def _mask(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in places:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Truth table of URLs by rules."""
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        sizes = np.array([len(urls[i]) for i in order])
        flat = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        state = np.zeros((len(urls), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(sizes.max()) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t
            d = state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.inner
            moved |= self.float if t else self.begin
            state[:n] = (moved & self.accept[flat[starts[:n] + t]]) | (d & self.stay)
        out = np.zeros((len(urls), len(self.last)), bool)
        for k, last in enumerate(self.last):
            if last < 0:
                out[order, k] = True if last == -1 else sizes == 0
            else:
                out[order, k] = (state[:, last // 64] >> np.uint64(last % 64)) & one != 0
        return out


def canonical(url: Column) -> Column:
    """Trimmed, without fragment, default port and campaign parameters; scheme and host in lower case.

    A URL without ``scheme://`` keeps its text. The remaining parameters stay in their order.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    host = F.when(scheme == "http://", F.regexp_replace(host, ":80$", "")).when(scheme == "https://", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|gclid|fbclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), r"\?&", "?"), "[?&]$", "")
    return F.concat(scheme, host, F.when(rest == "", F.lit("/")).otherwise(rest))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """``(key, canonical_url, rules, verdict)`` for each row of ``pages``.

    ``rules`` lists the ids of all matching rules in rising order, joined by commas. The verdict is
    ``allow`` if an allow rule matches, else ``block`` if a block rule does, else ``pass``; a null URL
    has no canonical form, no rules and the verdict ``invalid``. An empty URL is matched like any
    other, and a URL of any length is read whole. Narrow: one pass over two columns, no shuffle. Repeated rows get the same verdict, an empty
    table gives no rows, further columns aren't read. ``?`` stands for one byte of the UTF-8 form.
    """
    ship(pages.sparkSession)
    order = sorted(rules, key=lambda r: r.rule_id)

    @F.pandas_udf("hits string, verdict string")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([r.glob for r in order])
        ids = np.array([str(r.rule_id) for r in order], dtype=object)
        allow = np.array([r.action == "allow" for r in order], dtype=bool)
        for urls in batches:
            known = urls.notna().to_numpy()
            table = automaton.run([(u or "").encode("utf-8", "replace") for u in urls]) & known[:, None]
            hits = [",".join(ids[row]) if row.any() else "" for row in table]
            good, bad = (table & allow).any(axis=1), (table & ~allow).any(axis=1)
            yield pd.DataFrame({"hits": hits, "verdict": np.where(~known, "invalid", np.where(good, "allow", np.where(bad, "block", "pass")))})

    out = pages.select(F.col(key), canonical(F.col(url)).alias("_u")).withColumn("_m", match("_u"))
    return out.select(F.col(key), F.col("_u").alias("canonical_url"), F.col("_m.hits").alias("rules"), F.col("_m.verdict").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_RULE_ROWS = ", ".join(f"({r.rule_id}, '{r.action}', '{r.glob}')" for r in RULES)
ORACLE_SQL = f"""
WITH r(rule_id, action, pattern) AS (VALUES {_RULE_ROWS}),
bare AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
part AS (
  SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) AS scheme,
         lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host,
         regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM bare
), cut AS (
  SELECT page_id, scheme,
         CASE WHEN scheme = 'http://' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https://' THEN regexp_replace(host, ':443$', '') ELSE host END AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '([?&])(utm_[a-z]+|gclid|fbclid)=[^&]*', '\\1', 'g'), '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]$', '') AS rest FROM part
), c AS (SELECT page_id, scheme || host || CASE WHEN rest = '' THEN '/' ELSE rest END AS canonical_url FROM cut)
SELECT page_id, canonical_url,
       coalesce(string_agg(rule_id::VARCHAR, ',' ORDER BY rule_id) FILTER (rule_id IS NOT NULL), '') AS rules,
       CASE WHEN canonical_url IS NULL THEN 'invalid' WHEN count(*) FILTER (action = 'allow') > 0 THEN 'allow'
            WHEN count(*) FILTER (action = 'block') > 0 THEN 'block' ELSE 'pass' END AS verdict
FROM c LEFT JOIN r ON c.canonical_url GLOB r.pattern GROUP BY page_id, canonical_url
"""
