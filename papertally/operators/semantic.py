"""Ranking of items by vector similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.functions.positions import top_rows
from papertally.functions.vectors import as_double, norm

# Number of ranked items, digits of a score.
TOP_ITEMS = 8
SCORE_DIGITS = 3

# Largest number of query vectors that travels to every task.
MAX_SHIPPED_QUERIES = 2000


def rank_items(queries: DataFrame, items: DataFrame, k: int = TOP_ITEMS) -> DataFrame:
    """(query, item, score, rank): the ``k`` most similar items of each query.

    ``queries``: (query, vector), at most ``MAX_SHIPPED_QUERIES`` of them (a
    larger set fails; use :func:`rank_items_blocked`); ``items``: (item,
    vector). The queries are packed into one scalar subquery that every task
    reads, so item vectors are neither shuffled nor sent to Python. Scores are
    rounded before ranking; equal ones are ordered by item. Each task keeps
    ``k`` rows per query before anything is exchanged.
    """
    bounded = queries.limit(MAX_SHIPPED_QUERIES + 1).select(
        F.struct("query", as_double(F.col("vector")).alias("v"), norm(F.col("vector")).alias("n")).alias("q")
    )
    size = F.count(F.lit(1))
    packed = bounded.agg(
        F.when(size > MAX_SHIPPED_QUERIES, F.raise_error(F.lit("too many queries: use rank_items_blocked"))).otherwise(
            F.collect_list("q")
        ).alias("qs")
    ).scalar()
    ready = items.select("item", as_double(F.col("vector")).alias("v"), norm(F.col("vector")).alias("n"))
    pairs = ready.withColumn("q", F.explode(packed))
    products = F.zip_with(F.col("q.v"), F.col("v"), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    length = F.col("q.n") * F.col("n")
    score = F.when(length > 0, F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) / length).otherwise(0.0)
    scored = pairs.select(F.col("q.query").alias("query"), "item", F.round(score, SCORE_DIGITS).alias("score"))
    return top_rows(scored, ["query"], [F.col("score").desc(), F.col("item")], k, "rank")


def rank_items_blocked(
    queries: DataFrame, items: DataFrame, k: int = TOP_ITEMS, query_rows: int = 4000, item_rows: int = 40000
) -> DataFrame:
    """The same for any number of queries of one dimension.

    Queries and items are hashed into blocks of about ``query_rows`` and
    ``item_rows`` vectors, so a task's memory does not grow with the tables.
    The blocks meet pair by pair, each task returning the best ``k`` per query;
    a second top-k merges the blocks.
    """

    def blocks(df: DataFrame, rows: int) -> Column:
        # counted by the query itself when it runs, not by an action here
        needed = F.ceil(F.count(F.lit(1)) / rows).cast("int")
        return df.agg(F.greatest(needed, F.lit(1)).alias("n")).scalar()

    def block_of(name: str, count: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(count)).cast("int")

    counts = {"_qn": blocks(queries, query_rows), "_in": blocks(items, item_rows)}
    every = {side: F.explode(F.sequence(F.lit(0), F.col(side) - 1)) for side in counts}
    left = queries.withColumns(counts).select("query", "vector", block_of("query", "_qn").alias("qb"), every["_in"].alias("ib"))
    right = items.withColumns(counts).select("item", "vector", block_of("item", "_in").alias("ib"), every["_qn"].alias("qb"))

    def multiply(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query": [], "item": [], "score": []})
        a = np.array(q["vector"].tolist(), dtype="float64")
        b = np.array(i["vector"].tolist(), dtype="float64")
        a_length, b_length = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        names = i["item"].to_numpy()
        out = []
        for row, query in enumerate(q["query"]):
            length = a_length[row] * b_length
            scores = np.divide(b @ a[row], length, out=np.zeros(len(b)), where=length > 0).round(SCORE_DIGITS)
            # everything that ties with the k-th score stays in until names decide
            floor = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
            good = np.flatnonzero(scores >= floor)
            best = good[np.lexsort((names[good], -scores[good]))][:k]
            out.append(pd.DataFrame({"query": query, "item": names[best], "score": scores[best]}))
        return pd.concat(out)

    types = f"query {queries.schema['query'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double"
    partial = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(multiply, types)
    return top_rows(partial, ["query"], [F.col("score").desc(), F.col("item")], k, "rank")
