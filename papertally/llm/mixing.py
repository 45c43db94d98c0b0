"""Mixing sources to target weights by hierarchical budgets.

Weights run down a tree of levels (such as domain, language, source). A node's
tokens are shared among its children by weight; a child that cannot use its
share, even with all epochs, leaves the rest to its siblings, and only what the
whole family cannot use goes on to the parent's siblings. A leaf then takes the
prefix that fills its budget from its seeded epochs: each epoch is the leaf's
documents in an order of its own.

All of it is DataFrame work. Tree tables have a row a node; documents are cut by
one key per leaf, so no leaf, however large, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertally.llm.registry import query, table
from papertally.session import written

#: First hex digits of the order key that part a leaf's documents for sums.
BUCKET_DIGITS = 3
_EXACT = "decimal(38,0)"


def token_count() -> Column:
    """Words of the text, parted by ASCII white space."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _node(levels: Sequence[str], depth: int) -> Column:
    """The node of a row at a depth: its path, null unlike any name."""
    if depth == 0:
        return F.lit("")
    parts = [
        F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("/"), F.lit("//"))), F.lit("null"))
        for c in levels[:depth]
    ]
    return F.concat_ws("/ ", *parts)


def share(nodes: DataFrame) -> DataFrame:
    """Budgets of children: ``nodes`` has ``parent``, ``node``, ``weight``,
    ``capacity`` and the parent's ``given``; adds ``budget``.

    Children whose capacity is less than their share are filled first, in the
    order of capacity per weight; the others share what is left by weight,
    fractions rounded down. Exact in decimals.
    """
    order = [(F.col("capacity").cast("double") / F.col("weight")), F.col("node")]
    before = Window.partitionBy("parent").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("parent").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy("parent")
    left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    summed = nodes.select("*", left.cast(_EXACT).alias("_left"), F.sum("weight").over(onward).cast(_EXACT).alias("_w"))
    full = F.col("capacity").cast(_EXACT) * F.col("_w") <= F.col("_left") * F.col("weight")
    marked = summed.withColumn("_full", full)
    # the first child that is not filled up knows what all others share
    first = F.min(F.when(~F.col("_full"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "_left", "_w")))
    shared = marked.withColumn("_f", first.over(family))
    part = F.expr("CAST((CAST(greatest(_f._left, 0) AS DECIMAL(38,0)) * weight) div _f._w AS BIGINT)")
    filled = F.col("_f").isNull() | (F.struct(*order) < F.struct(F.col("_f.o0"), F.col("_f.o1")))
    budget = F.when(filled, F.col("capacity")).otherwise(part).cast("bigint")
    return shared.withColumn("budget", budget).drop("_left", "_w", "_full", "_f")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: Column | None, max_epochs: int
) -> DataFrame:
    """Budget of each leaf. ``leaves`` has the ``levels`` and ``tokens``;
    ``weights`` is one integer column per level (less than 1 counts as 1), over
    the level names down to it and the node's ``tokens``;
    ``budget`` the tokens wanted, over the sum ``tokens`` of all leaves; without
    one it is the least that gives every leaf all its tokens once."""
    depth = len(levels)
    tree = leaves.select(
        *levels,
        F.col("tokens").cast("bigint"),
        *[_node(levels, d).alias(f"_node{d}") for d in range(depth + 1)],
    )

    def nodes_at(d: int) -> DataFrame:
        """The nodes of a depth with their parents, tokens and weights."""
        summed = tree.groupBy(F.col(f"_node{d - 1}").alias("parent"), F.col(f"_node{d}").alias("node"), *levels[:d])
        nodes = summed.agg(F.sum("tokens").alias("tokens"))
        return nodes.select("parent", "node", "tokens", F.greatest(weights[d - 1].cast("bigint"), F.lit(1)).alias("weight"))

    if budget is None:
        shares = tree.withColumn("_share", F.lit(1.0))
        for d in range(1, depth + 1):
            part = F.col("weight") / F.sum("weight").over(Window.partitionBy("parent"))
            shares = shares.join(nodes_at(d).select(F.col("node").alias(f"_node{d}"), part.alias("_part")), f"_node{d}")
            shares = shares.withColumn("_share", F.col("_share") * F.col("_part")).drop("_part")
        # a little more, as fractions are rounded down on the way to a leaf
        least = F.max((F.col("tokens") + depth + 1) / F.col("_share")) * (1 + 1e-9)
        total = shares.agg(F.ceil(least).alias("tokens"))
        budget = F.col("tokens")
    else:
        total = tree.agg(F.sum("tokens").alias("tokens"))
    given = total.select(
        F.lit("").alias("parent"), F.coalesce(budget, F.lit(0)).cast("bigint").alias("given")
    )
    for d in range(1, depth + 1):
        nodes = nodes_at(d).withColumn("capacity", F.col("tokens") * max_epochs).drop("tokens")
        shared = share(nodes.join(given, "parent"))
        given = shared.select(F.col("node").alias("parent"), F.col("budget").alias("given"))
    return tree.withColumn("parent", F.col(f"_node{depth}")).join(given, "parent").select(
        F.col("parent").alias("leaf"), *levels, "tokens", F.col("given").alias("budget")
    )


def _order_key(seed: str, epoch: Column) -> Column:
    """Where a document stands in an epoch; rows of one doc_id stand together."""
    return F.md5(
        F.concat(
            F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
        ).cast("binary")
    )


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Sequence[Column],
    budget: Column | None = None,
    max_epochs: int = 4,
    seed: str = "mix",
) -> DataFrame:
    """The mixture: the rows of ``docs`` once per epoch that takes them, with
    ``mix_epoch`` (from 0), ``mix_tokens`` (words of the text) and ``mix_taken``
    (fewer only for the document at the end of a leaf's budget).

    ``levels`` are columns of ``docs``, from the root down; null is a name of its
    own. Every document has its leaf; a document without words is taken in the
    epochs that are taken whole. Rows of one doc_id in one leaf share their
    place, and if the budget ends there all of them are taken. Columns of
    ``docs`` with the names of the new ones are replaced, all others stay. An empty table gives
    an empty mixture. Counts and the cut keys are written at once (actions).
    """
    names = [c for c in docs.columns if c not in ("mix_epoch", "mix_tokens", "mix_taken")]
    # under names of our own no column of the caller's meets one of the steps'
    own = {c: f"own_{i}" for i, c in enumerate(names)}
    leaf = _node(levels, len(levels))
    narrow = written(docs.select("doc_id", *levels, leaf.alias("leaf"), token_count().alias("tokens")))
    totals = narrow.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(totals, levels, weights, budget, max_epochs)
    has = F.col("tokens") > 0
    rest = F.when(has, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).cast("bigint")
    whole = F.when(has, F.floor(F.expr("budget div tokens"))).otherwise(F.lit(1)).cast("int")
    plan = written(budgets.select("leaf", "budget", whole.alias("_whole"), rest.alias("_rest")))

    # the key up to which each leaf's last, partial epoch is taken
    keyed = narrow.join(plan.where("_rest > 0"), "leaf").select(
        "leaf", "_rest", "tokens", _order_key(seed, F.col("_whole")).alias("_key")
    ).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy("leaf", "_bucket").agg(F.sum("tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("_end", F.sum("_sum").over(upto)).withColumn("_before", F.col("_end") - F.col("_sum"))
    straddling = ends.where("_before < _rest AND _rest <= _end").select("leaf", "_bucket", "_before")
    inside = Window.partitionBy("leaf", "_bucket").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    walked = (
        keyed.join(straddling, ["leaf", "_bucket"])
        .groupBy("leaf", "_bucket", "_key", "_rest", "_before").agg(F.sum("tokens").alias("tokens"))
        .withColumn("_start", F.col("_before") + F.sum("tokens").over(inside) - F.col("tokens"))
        .where("_start < _rest")
    )
    cut = walked.groupBy("leaf").agg(F.max(F.struct("_key", "_start")).alias("_cut"))
    plan = written(plan.join(cut, "leaf", "left").select("leaf", "_whole", "_rest", "_cut"))

    kept = [docs[f"`{c}`"].alias(n) for c, n in own.items()]
    rows = docs.select(*kept, "doc_id", leaf.alias("_leaf"), token_count().alias("mix_tokens"))
    planned = rows.join(plan, F.col("_leaf") == F.col("leaf"))
    last = _order_key(seed, F.col("_whole"))
    partial = F.col("_cut").isNotNull() & (last <= F.col("_cut._key"))
    epochs = F.sequence(F.lit(0), F.col("_whole") - F.when(partial, 0).otherwise(1))
    counted = planned.where((F.col("_whole") > 0) | partial).select(
        "*", F.when(last == F.col("_cut._key"), F.col("_rest") - F.col("_cut._start")).alias("_end"), F.explode(epochs).alias("mix_epoch")
    )
    taken = F.when(
        (F.col("mix_epoch") == F.col("_whole")) & F.col("_end").isNotNull(), F.least("mix_tokens", "_end")
    ).otherwise(F.col("mix_tokens"))
    return counted.select(*[F.col(n).alias(c) for c, n in own.items()], "mix_epoch", "mix_tokens", taken.alias("mix_taken"))


def source_domain() -> Column:
    """The domain of a source of the given tables: its number modulo 4."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)")
    return F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % 4).cast("string"))


LEVELS = ["domain", "lang", "source"]


def production_weights() -> list[Column]:
    """Domains 4:3:2:1, English half of each, sources alike."""
    return [
        F.lit(4) - F.substring("domain", 2, 1).cast("int"),
        F.when(F.col("lang") == "en", 6).when(F.col("lang").isin("de", "fr"), 2).otherwise(1),
        F.lit(1),
    ]


@query(
    "op4_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain, lang,
             source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
      FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, 4 * sum(tokens)::HUGEINT AS cap,
                      4 - substr(domain, 2, 1)::INT AS w1,
                      CASE WHEN lang = 'en' THEN 6 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS w2
               FROM d GROUP BY domain, lang, source),
    n1 AS (SELECT domain, max(w1)::HUGEINT AS w, sum(cap)::HUGEINT AS cap, (SELECT sum(tokens)::HUGEINT FROM leaves) AS given
           FROM leaves GROUP BY domain),
    s1 AS (SELECT *, given - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                  sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n1),
    f1 AS (SELECT l, ws FROM s1 WHERE NOT cap * ws <= l * w ORDER BY cap / w, domain LIMIT 1),
    b1 AS (SELECT domain, CASE WHEN cap * ws <= l * w THEN cap
                  ELSE (SELECT (greatest(f1.l, 0)::HUGEINT * w) // f1.ws::HUGEINT FROM f1) END AS given FROM s1),
    n2 AS (SELECT domain, lang, max(w2)::HUGEINT AS w, sum(cap)::HUGEINT AS cap, any_value(given)::HUGEINT AS given
           FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang),
    s2 AS (SELECT *, given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                  sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n2),
    f2 AS (SELECT domain, arg_min(l, (cap / w, lang)) AS fl, arg_min(ws, (cap / w, lang)) AS fw FROM s2
           WHERE NOT cap * ws <= l * w GROUP BY domain),
    b2 AS (SELECT domain, lang, CASE WHEN cap * ws <= l * w THEN cap
                  ELSE (greatest(fl, 0)::HUGEINT * w) // fw::HUGEINT END AS given FROM s2 LEFT JOIN f2 USING (domain)),
    n3 AS (SELECT domain, lang, source, tokens, cap, given::HUGEINT AS given FROM leaves JOIN b2 USING (domain, lang)),
    s3 AS (SELECT *, given - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                  count(*) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM n3),
    f3 AS (SELECT domain, lang, arg_min(l, (cap, source)) AS fl, arg_min(ws, (cap, source)) AS fw FROM s3
           WHERE NOT cap * ws <= l GROUP BY domain, lang),
    b3 AS (SELECT domain, lang, source, tokens, (CASE WHEN cap * ws <= l THEN cap
                  ELSE greatest(fl, 0)::HUGEINT // fw::HUGEINT END)::BIGINT AS budget FROM s3 LEFT JOIN f3 USING (domain, lang)),
    e AS (SELECT d.*, budget, CASE WHEN b3.tokens > 0 THEN budget // b3.tokens ELSE 1 END AS whole,
                 CASE WHEN b3.tokens > 0 THEN budget % b3.tokens ELSE 0 END AS rest
          FROM d JOIN b3 USING (domain, lang, source)),
    x AS (SELECT *, unnest(range(0, (whole + 1)::BIGINT)) AS mix_epoch FROM e),
    o AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, mix_epoch
                 ORDER BY md5('mix:' || mix_epoch || ':' || doc_id) ROWS UNBOUNDED PRECEDING) - tokens AS before FROM x)
    SELECT doc_id, domain, lang, source, mix_epoch::INT AS mix_epoch, tokens::BIGINT AS mix_tokens,
           (CASE WHEN mix_epoch < whole THEN tokens ELSE least(tokens, rest - before) END)::BIGINT AS mix_taken
    FROM o WHERE mix_epoch < whole OR before < rest
    """,
)
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("domain", source_domain())
    mixed = mix(docs, LEVELS, production_weights(), F.col("tokens"))
    return mixed.select("doc_id", *LEVELS, "mix_epoch", "mix_tokens", "mix_taken")
