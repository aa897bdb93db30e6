"""Judging URLs by rules for hosts and paths, and by a list of unwanted URLs behind a blocked Bloom filter."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from nearwise.operators import bloom
from nearwise.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name the way to a page, not the page.
TRACKING = r"^(utm_.*|ref|fbclid|gclid)(=|$)"
#: Rules become one expression.
MAX_RULES = 256


class Rule(NamedTuple):
    """``action`` for a host and its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it or for null."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    start = F.instr(url, "://")
    return F.coalesce(F.when(start > 0, F.substr(url, start + 3)), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The spelling under which URLs are listed; null without a host.

    Scheme, fragment, a leading ``www.``, the ports 80 and 443, slashes at the path's end and tracking parameters go; the
    other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), asked))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of the ``rule`` (host and path) that fits and its ``action``; null when none fits.

    The longest wins; of rules of one length that both fit, one that blocks, then the first in order.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; longer lists belong into the table of listed URLs")
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.action != "block", r.host + r.path))
    for rule in reversed(ordered):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(chosen)
    return chosen


def is_listed(
    rows: DataFrame, key: str, listed: DataFrame, name: str = "listed", broadcast_bytes: int = bloom.BROADCAST_BYTES
) -> DataFrame:
    """``rows`` with a boolean column that tells whether ``key`` is among the keys of ``listed``, a table of one column.

    The blocked Bloom filter grows with the list. Rows that it turns away go on where they lie; possible
    hits (all true ones and about one other row in 500) are joined with the list itself. A filter of more than
    ``broadcast_bytes`` is joined by shuffle, as is the list unless Spark knows it to be small; both joins keep rows on the
    left, so Spark splits partitions of a URL that many rows have. A null key is not listed.
    """
    keys = materialize(listed.toDF("listed_key").where(F.col("listed_key").isNotNull()).distinct(), "listed")
    probed = bloom.with_possible(rows, bloom.quoted(key), keys, keys.count(), broadcast_bytes)
    hits = probed.where("possible").join(keys, F.col("probe") == F.col("listed_key"), "left")
    judged = probed.where("NOT possible").select("row", F.lit(False).alias(name)).union(
        hits.select("row", F.col("listed_key").isNotNull().alias(name))
    )
    return judged.select("row.*", name)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], broadcast_bytes: int = bloom.BROADCAST_BYTES
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    The longest rule that fits decides; without one, a URL whose canonical form is among those of ``listed`` (one column,
    canonical) is blocked and any other allowed. All is column expressions and joins. A null URL, or one without ``://``,
    has an empty host and path, which no rule fits and no list holds. Repeated rows and ids are judged row by row; an empty
    list blocks nothing. Of other columns only ``page_id`` and ``url`` are read.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
    found = is_listed(rows, "canonical", listed, broadcast_bytes=broadcast_bytes)
    found = found.withColumn("chosen", longest_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "chosen.rule", F.coalesce("chosen.action", method).alias("verdict"))
