"""URL filters: host and path rules, then a list of canonical URLs, in DataFrame functions only.

The list can be long.  A blocked Bloom filter of it (one block of 256 bits per URL, ``BITS`` bits set
within the block) is built by ``bit_or`` per block.  If the filter is within
``BROADCAST_BYTES`` it is sent to the executors, so that pages stream past it without a
shuffle; else pages meet their block by an ordinary join.  Only possible hits go into
the exact join with the listed URLs, which removes false positives.

Canonical: scheme and fragment dropped, host in lower case without ``www.`` and default ports, trailing slashes and
tracking parameters (``TRACKING``: those that never choose a page's content) dropped, empty parameters too.

Defined cases: null, or no ``://``: host and path are empty, there is no canonical URL, no rule fits and
the verdict is allow.  Repeated rows and equal ids are judged one by one.  Other columns
are not read.  An empty list blocks nothing.  The list is counted, for the size of its filter, while the query is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import ascii_lower

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)="
BLOCK_BITS = 256
BITS = 8
BITS_PER_URL = 16
BROADCAST_BYTES = 16 << 20
BLOCK_BYTES = 64  # of a row of the filter
MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with its path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, PARTS, 1)), F.regexp_extract(url, PARTS, 2)


def canonical(url: Column) -> Column:
    """Null where there is no ``://``."""
    host, path = parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    given = F.split(F.substring(F.regexp_extract(url, PARTS, 3), 2, 1 << 30), "&")
    kept = F.array_join(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    query = F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(host, F.regexp_replace(path, "/+$", ""), query))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _words(url: Column) -> list[Column]:
    """The bits of a URL within its block, as four words of 64."""
    mixed = F.xxhash64(url, F.lit("bits"))
    places = [F.shiftrightunsigned(mixed, 8 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(BITS)]
    return [
        reduce(
            lambda a, b: a.bitwiseOR(b),
            (F.when(F.shiftright(p, 6) == w, _power(p.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for p in places),
        )
        for w in range(BLOCK_BITS // 64)
    ]


def _power(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks: ``block, w0 .. w3``."""
    words = _words(F.col("canonical"))
    return (
        listed.select(_block(F.col("canonical"), blocks).alias("block"), *(w.alias(f"w{k}") for k, w in enumerate(words)))
        .groupBy("block")
        .agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(words))))
    )


def url_filter(pages: DataFrame, listed_urls: DataFrame, rules: list[Rule], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    ``listed_urls`` has a column ``url``; ``rules`` are few (a parameter, at most ``MAX_RULES``).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    listed = listed_urls.select(canonical(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL").distinct()
    blocks, wanted = 1, listed.count() * BITS_PER_URL
    while blocks * BLOCK_BITS < wanted:
        blocks *= 2
    filter_rows = bloom(listed, blocks)
    if blocks * BLOCK_BYTES <= broadcast_bytes:
        filter_rows = F.broadcast(filter_rows)
    host, path = parts(F.col("url"))
    seen = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    # Longest rule first, so that the first that fits wins.
    ordered = sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    seen = seen.withColumn("rule", F.coalesce(*(F.when(r.fits(), F.lit(str(r))) for r in ordered), F.lit(None).cast("string")))
    seen = seen.withColumn("block", _block(F.col("canonical"), blocks))
    probed = seen.join(filter_rows, "block", "left")
    bits = _words(F.col("canonical"))
    possible = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"w{k}").bitwiseAND(w) == w, F.lit(False)) for k, w in enumerate(bits)))
    possible = F.coalesce(F.col("canonical").isNotNull() & possible, F.lit(False))
    probed = probed.select("page_id", "host", "path", "rule", "canonical", possible.alias("possible"))
    sure = probed.filter(~F.col("possible")).withColumn("listed", F.lit(False))
    hits = probed.filter("possible").join(listed.withColumn("found", F.lit(True)), "canonical", "left")
    hits = hits.withColumn("listed", F.coalesce("found", F.lit(False)))
    by_rule = F.coalesce(*(F.when(F.col("rule") == str(r), F.lit(r.verdict)) for r in ordered), F.lit(None).cast("string"))
    columns = ["page_id", "host", "path", "rule", "listed"]
    return (
        sure.select(columns)
        .unionByName(hits.select(columns))
        .withColumn("verdict", F.coalesce(by_rule, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))))
    )


def oracle_sql(rules: list[Rule], listed: str) -> str:
    """``listed`` is a condition on ``canonical`` that says which pages' URLs make up the list."""
    ordered = sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    name = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in ordered)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{r.verdict}'" for r in ordered)
    return rf"""
WITH p AS (
  SELECT page_id, contains(coalesce(url, ''), '://') AS known, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', ['h', 'p', 'q']) AS x
  FROM pages),
h AS (
  SELECT page_id, known, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path,
         list_filter(string_split(substr(x.q, 2), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '{TRACKING}')) AS kept FROM p),
c AS (
  SELECT page_id, host, path, CASE {name} END AS rule,
         CASE WHEN known THEN regexp_replace(regexp_replace(host, ':(?:80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END END AS canonical FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND {listed})
SELECT page_id, host, path, rule, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l) AS listed,
       CASE {verdict} WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
