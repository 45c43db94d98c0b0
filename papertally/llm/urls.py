"""Verdicts on URLs by rules for hosts and paths.

A rule names a host, with all its subdomains, and the beginning of a path. Each
URL is expanded into the suffixes of its host and the beginnings of its path, as
far as rules can reach. Expressions meet rules on the first 32 bits of their
digest; the whole digest confirms, and of the rules that fit the longest wins.
All of it is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.registry import query, table
from papertally.session import written

#: Verdict where no rule fits.
DEFAULT = "allow"
#: So many hosts and beginnings of paths, those with most rows, are broadcast.
HOT_PLACES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the path, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    """Of an expression; a line break, which no rule has, keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _reach(rules: DataFrame) -> tuple[int, int, list[int]]:
    """How many labels and path characters rules have at most, and the lengths of
    paths that don't end in a slash: three numbers or lists no longer than a path."""
    labels = F.size(F.split("host", "\\."))
    ends = F.collect_set(F.when(F.col("path").endswith("/"), None).otherwise(F.length("path")))
    row = rules.agg(F.max(labels).alias("a"), F.max(F.length("path")).alias("b"), F.sort_array(ends).alias("c")).first()
    return row.a or 0, row.b or 0, list(row.c)


def _suffixes(host: Column, most: int) -> Column:
    """A host and the hosts above it, of at most so many labels."""
    labels = F.split(host, "\\.", -1)
    counts = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    return F.transform(counts, lambda n: F.array_join(F.slice(labels, -n, n), "."))


def _beginnings(path: Column, ends: list[int]) -> Column:
    """Beginnings of a path up to each slash and of each of the given lengths."""
    parts = F.split(path, "/", -1)
    slashes = F.size(parts) - 1
    cut = F.transform(F.sequence(F.lit(1), slashes), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    at_slashes = F.when(slashes > 0, cut).otherwise(F.array().cast("array<string>"))
    others = [F.when(F.length(path) >= end, F.substring(path, 1, end)) for end in ends]
    return F.array_compact(F.array_distinct(F.concat(at_slashes, F.array(*others).cast("array<string>"))))


def _winners(places: DataFrame, rules: DataFrame, reach: tuple[int, int, list[int]]) -> DataFrame:
    """For each ``host`` and ``begin`` of ``places`` that a rule fits: ``best``,
    the rule that wins, with its verdict."""
    labels, _, ends = reach
    if not labels:
        return places.select("host", "begin").limit(0).withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    listed = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("rule_short", _short(F.col("rule_digest")))
    suffixes = places.select("host", "begin", F.explode(_suffixes(F.col("host"), labels)).alias("suffix"))
    each = suffixes.select("host", "begin", "suffix", F.explode(_beginnings(F.col("begin"), ends)).alias("part"))
    expressions = each.select("host", "begin", _digest(F.col("suffix"), F.col("part")).alias("digest"))
    met = expressions.withColumn("short", _short(F.col("digest"))).join(listed, F.col("short") == F.col("rule_short"))
    rank = F.struct(F.length("rule"), F.col("host_length"), F.col("verdict") == "block", F.col("verdict"))
    confirmed = met.where("digest = rule_digest")
    return confirmed.groupBy("host", "begin").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``host``, ``path``,
    ``rule`` (host and path of the rule that wins, else null) and ``verdict``.
    Further columns of ``pages``, html among them, are not read.

    ``rules`` has ``host``, ``path`` and ``verdict``; hosts count in lower case, a
    rule with a null in it fits nothing. A rule fits where the URL's host is its
    host or below it and the URL's path begins with its path. Of rules that fit
    the one with the longest host and path wins; at a tie the one with the longer
    host, then ``block`` over other verdicts. A URL that is null or has no ``://``
    has empty host and path, which only a rule with neither fits. Long URLs are
    judged whole; no more of a host or path is expanded than rules reach. Repeated
    rows stay repeated, an empty table gives no rows, and without rules every URL
    gets ``default``. Three small actions: the reach of the rules, and two tables
    of the distinct hosts with beginnings of paths.
    """
    known = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict")
    ).dropna()
    reach = _reach(known)
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("begin", F.substring("path", 1, reach[1]))
    # many URLs begin alike as far as rules reach: each beginning is looked up once
    places = written(rows.groupBy("host", "begin").agg(F.count(F.lit(1)).alias("n")))
    found = written(places.join(_winners(places, known, reach), ["host", "begin"], "left"))
    # the places with most rows are known to every task; a host that none has deals their rows out evenly
    most = found.orderBy(F.desc("n"), "host", "begin").limit(HOT_PLACES)
    hot = most.select("host", "begin", F.col("best").alias("hot"), F.lit(True).alias("is_hot"))
    dealt = F.when(F.col("is_hot"), F.concat(F.lit("/"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("host"))
    rows = rows.join(F.broadcast(hot), ["host", "begin"], "left").withColumn("dealt", dealt)
    others = found.where("best IS NOT NULL").select(F.col("host").alias("dealt"), "begin", "best")
    best = F.coalesce("hot", "best")
    return rows.join(others, ["dealt", "begin"], "left").select(
        "page_id", "url", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )


def without_blocked(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The rows of ``pages``, with all their columns, whose URL is not blocked."""
    judged = filter_urls(pages, rules, default).where("verdict = 'block'").select(F.col("url").alias("_blocked")).distinct()
    return pages.join(judged, pages["url"].eqNullSafe(judged["_blocked"]), "left_anti")


#: The rules of the query: host, path, verdict.
GIVEN = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

SQL = f"""
    WITH r(host, path, verdict) AS (VALUES {", ".join(map(str, GIVEN))}),
    p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    m AS (SELECT page_id, u.host, u.path, max(CASE WHEN r.host IS NOT NULL THEN {{'n': length(r.host || r.path), 'h': length(r.host),
                   'rule': r.host || r.path, 'verdict': r.verdict}} END) AS best
          FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
          GROUP BY page_id, u.host, u.path)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{DEFAULT}') AS verdict FROM m"""


@query("op11_url_filter", SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    # as literals, so that the plan knows how small they are
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, GIVEN))} AS r(host, path, verdict)")
    return filter_urls(table(spark, folder, "pages"), rules).drop("url")
