"""Secrets in texts, judged by who owns them across the corpus.

Patterns find candidates. Their values, hashed, are counted over the whole
corpus by distinct repositories and owners: what many owners hold is a copied
example; what one owner holds and looks random is taken for live. Base kinds
are always reported; further kinds only where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.llm.registry import query, table
from papertally.session import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order: pattern, group of the value, least length of it.
#: For runs of one class a least length in the pattern finds the same spans as a
#: check afterwards.
BASE = [("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32)]
#: Further kinds. They count where they look live and touch no base span.
FURTHER = [
    ("vendor", r"\b(?:gh[opsu]_|glpat-|xox[abprs]-|[srp]k_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("bearer", r"\b[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20),
]
#: A value of this many owners or more is a widely copied example.
EXAMPLE_OWNERS = 3
#: Distinct characters that a live value has at least.
LIVE_CHARACTERS = 8
_BLOCK = 256


def _running(start: Column, values: Column) -> Column:
    step = lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"] + v)).alias("out"))
    none = F.array().cast("array<bigint>")
    return F.aggregate(values, F.struct(start.cast("bigint").alias("at"), none.alias("out")), step)["out"]


def running_sums(values: Column) -> Column:
    """The sums of an array up to each element, in blocks so that long arrays
    are not copied once an element."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK),
    )
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), _running(F.lit(0), sums))
    return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), lambda x, b: _running(b, x)))


SPAN = "array<struct<start:bigint,no:int,kind:string,end:bigint,value:string>>"


def _spans(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All spans of a kind, start and end in code points. What lies between the
    matches has known lengths, so positions are running sums."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    size = lambda x: F.length(x).cast("bigint")
    lengths = F.flatten(F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, p: F.array(size(p), size(m))))
    ends = running_sums(lengths)
    spans = F.transform(
        found,
        lambda m, i: F.struct(
            F.element_at(ends, 2 * i + 1).alias("start"),
            F.lit(no).alias("no"),
            F.lit(kind).alias("kind"),
            F.element_at(ends, 2 * i + 2).alias("end"),
            (m if group == 0 else F.regexp_extract(m, pattern, group)).alias("value"),
        ),
    )
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPAN)).cast(SPAN)


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``_key`` (what the row holds),
    ``repository``, ``owner``, and the spans ``base`` and ``further``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [*BASE, *FURTHER]
    found = docs.select(
        "doc_id",
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.sha2(text, 256)).alias("_key"),
        repository.alias("repository"),
        owner.alias("owner"),
        *[_spans(text, no, *name).alias(f"_{name[0]}") for no, name in enumerate(names)],
    )
    base = F.concat(*[F.col(f"_{name[0]}") for name in BASE])
    further = F.concat(*[F.col(f"_{name[0]}") for name in FURTHER])
    clear = F.filter(
        further, lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )
    hashed = lambda spans: F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["no"].alias("no"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"), _live(s["value"]).alias("random"),
        ),
    )
    whole = found.withColumn("base", base).withColumn("further", clear)
    return whole.select(
        "doc_id", "_key", "repository", "owner", hashed(F.col("base")).alias("base"), hashed(F.col("further")).alias("further")
    )


def _live(value: Column) -> Column:
    """Does a value look random: letters and digits, many of them distinct?"""
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a value: in how many distinct repositories and of how many
    distinct owners it lies (null is an owner like any other)."""
    spans = found.select("repository", "owner", F.explode(F.concat("base", "further")).alias("s"))
    places = spans.select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
    owners = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("_n"))
    return owners.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("_n").cast("bigint").alias("n_repositories")
    )


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text`` and what ``repository``
    and ``owner`` read): counts of base spans, ``base_sha256``, ``spans``,
    ``n_live`` (base and further spans of one or two owners that look random)
    and ``n_examples`` (spans of widely copied values).

    A null text counts as empty; an empty table gives no rows; a repeated row
    gives the same result each time. One write (action).
    """
    found = written(candidates(docs, repository, owner))
    tagged = lambda c, is_base: F.transform(c, lambda s: F.struct(s["start"], s["no"], s["kind"], s["end"], s["hash"], s["random"], F.lit(is_base).alias("base")))  # noqa: E731,E501
    each = found.select("_key", F.explode(F.concat(tagged("base", True), tagged("further", False))).alias("s"))
    judged = each.join(ownership(found), F.col("s.hash") == F.col("hash")).select(
        "_key",
        F.struct(
            F.col("s.start").alias("start"), F.col("s.no").alias("no"), F.col("s.kind").alias("kind"),
            F.col("s.end").alias("end"), F.col("s.base").alias("base"),
            (F.col("s.random") & (F.col("n_owners") < EXAMPLE_OWNERS)).alias("live"),
            (F.col("n_owners") >= EXAMPLE_OWNERS).alias("example"),
        ).alias("s"),
    )
    by_row = judged.groupBy("_key").agg(F.array_sort(F.collect_set("s")).alias("_all"))
    rows = found.join(by_row, "_key", "left").withColumn("_all", F.coalesce("_all", F.array().cast(by_row.schema["_all"].dataType)))
    count = lambda test: F.size(F.filter("_all", test)).cast("bigint")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind)
    kinds = [of_kind(kind).alias(f"n_{kind}") for kind, *_ in BASE]
    kept = F.filter("_all", lambda s: s["base"] | s["live"])
    return rows.select(
        "doc_id",
        *kinds,
        F.sha2(_joined(F.filter("_all", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(kept).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_examples"),
    )


def _sql() -> str:
    def one(no: int, kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {group})" if group else "m"
        return f"""SELECT * FROM (SELECT doc_id, owner, repository, {no} AS no, '{kind}' AS kind, {value} AS value,
              (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
              length(m) AS n
            FROM (SELECT doc_id, owner, repository, ms, ps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
                  FROM (SELECT doc_id, owner, repository, regexp_extract_all(text, '{p}') AS ms,
                               string_split_regex(text, '{p}') AS ps FROM d WHERE regexp_matches(text, '{p}'))))
            WHERE length(value) >= {least}"""

    spans = " UNION ALL ".join(one(no, *name) for no, name in enumerate([*BASE, *FURTHER]))
    n_base = len(BASE)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
                      coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
    a AS ({spans}),
    f AS (SELECT * FROM a WHERE no < {n_base} OR NOT EXISTS (SELECT 1 FROM a b WHERE b.no < {n_base}
             AND b.doc_id = a.doc_id AND b.s < a.s + a.n AND a.s < b.s + b.n)),
    o AS (SELECT value, count(DISTINCT owner) AS n_owners FROM f GROUP BY value),
    j AS (SELECT f.*, n_owners >= {EXAMPLE_OWNERS} AS example,
             n_owners < {EXAMPLE_OWNERS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
             AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS live
          FROM f JOIN o USING (value)),
    g AS (SELECT doc_id, count(*) FILTER (no = 0) AS a0, count(*) FILTER (no = 1) AS a1, count(*) FILTER (no = 2) AS a2,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) FILTER (no < {n_base}) AS b,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) FILTER (no < {n_base} OR live) AS k,
             count(*) FILTER (live) AS l, count(*) FILTER (example) AS e FROM j GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a0, 0) AS n_assign, coalesce(a1, 0) AS n_access, coalesce(a2, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(k, '') AS spans, coalesce(l, 0) AS n_live,
           coalesce(e, 0) AS n_examples
    FROM d LEFT JOIN g USING (doc_id)"""


@query("op5_secrets", _sql())
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    owner = F.coalesce("source", F.lit(""))
    repository = F.concat(owner, F.lit("/"), F.coalesce("lang", F.lit("")))
    return scan_secrets(table(spark, folder, "documents"), repository, owner)
