"""Who may see which dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_dashboards(dashboards: DataFrame, listed: DataFrame, user: str) -> DataFrame:
    """Enabled dashboards the user owns or is listed on, each once.

    ``dashboards``: (name, owner, enabled, ...); ``listed``: (parent, user).
    A guest sees none.
    """
    if user == "Guest":
        return dashboards.limit(0)
    own = listed.where(F.col("user") == user).select(F.col("parent").alias("name")).distinct().withColumn("_l", F.lit(True))
    return (
        dashboards.where(F.col("enabled") == 1)
        .join(own, "name", "left")
        .where((F.col("owner") == user) | F.col("_l").isNotNull())
        .select(*dashboards.columns)
        .distinct()
    )


def visible_to_each(dashboards: DataFrame, listed: DataFrame) -> DataFrame:
    """(user, name): the same for every user at once, owners and listed ones."""
    enabled = dashboards.where(F.col("enabled") == 1)
    owned = enabled.select(F.col("owner").alias("user"), "name")
    shared = listed.join(enabled.select(F.col("name").alias("parent")), "parent", "left_semi").select(
        "user", F.col("parent").alias("name")
    )
    return owned.unionByName(shared).where(F.col("user") != "Guest").distinct()


def access_checks(requests: DataFrame, dashboards: DataFrame, listed: DataFrame) -> DataFrame:
    """Requests (user, name, is_manager) with ``allowed``.

    A disabled dashboard is closed; one without sign-in is open; a guest is
    turned away; owner and manager may look; else the list decides.
    """
    boards = dashboards.select("name", "owner", "enabled", "require_auth").distinct()
    on_list = listed.select(F.col("parent").alias("name"), "user").distinct().withColumn("_l", F.lit(True))
    no, yes = F.lit(False), F.lit(True)
    allowed = (
        F.when(F.coalesce("enabled", F.lit(0)) == 0, no)
        .when(F.coalesce("require_auth", F.lit(0)) == 0, yes)
        .when(F.col("user") == "Guest", no)
        .when((F.col("user") == F.col("owner")) | F.col("is_manager"), yes)
        .otherwise(F.col("_l").isNotNull())
    )
    joined = requests.join(boards, "name").join(on_list, ["name", "user"], "left")
    kept = [c for c in requests.columns if c != "is_manager"]
    return joined.select(*kept, allowed.alias("allowed"))
