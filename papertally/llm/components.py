"""Connected components of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertally.session import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node it is connected with) for all ends
    of ``links`` (``a``, ``b``).

    Labels fall to the least of the neighbours' and then to the label's own
    label, which halves long chains. Each round is written, so its lineage is
    short and a lost executor costs no earlier round. All steps are aggregates,
    which combine within a task first, so a hub is no heavier than others.
    """
    edges = written(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(links.select(F.col("b"), F.col("a"))).where("node <> other").distinct()
    )
    labels = written(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        reached = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("_near"))
        near = labels.join(reached, "node").select("node", "label", F.least("label", "_near").alias("_next"))
        jump = labels.select(F.col("node").alias("_next"), F.col("label").alias("_jump"))
        after = written(
            near.join(jump, "_next", "left").select(
                "node", "label", F.least("_next", F.coalesce("_jump", "_next")).alias("_new")
            )
        )
        labels = after.select("node", F.col("_new").alias("label"))
        if after.where("label <> _new").isEmpty():
            return labels
