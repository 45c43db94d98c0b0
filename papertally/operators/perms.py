"""Permission tables: effective grants, missing rows, regressions, seeding.

``standard`` and ``custom``: (parent, role, permlevel, <one flag per ptype>).
A doctype with any custom row is governed by its custom rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.config import literal_array

# Permission flags in their usual order.
PTYPES = [
    "select", "read", "write", "create", "delete", "submit", "cancel",
    "amend", "report", "export", "import", "print", "email", "share",
    "set_user_permissions", "if_owner",
]

# What the reading role gets, and what it may never do.
BOT_ROLE = "AI Bot"
MANAGER_ROLE = "System Manager"
READ_PTYPES = ["read", "select", "report", "print", "email", "export"]
WRITE_PTYPES = [
    "write", "create", "delete", "submit", "cancel", "amend",
    "import", "share", "set_user_permissions",
]
ESCALATION_DOCTYPES = [
    "User", "Role", "Custom Role", "Role Profile", "Has Role",
    "DocPerm", "Custom DocPerm", "DocShare", "User Permission",
    "Property Setter", "Custom Field", "Client Script", "Server Script",
    "System Settings",
]


def shared_ptypes(standard: DataFrame, custom: DataFrame) -> list[str]:
    """Flags that both tables have, in their usual order."""
    return [p for p in PTYPES if p in standard.columns and p in custom.columns]


def _level() -> Column:
    return F.coalesce(F.col("permlevel"), F.lit(0)).cast("int")


def _rows(table: DataFrame, ptypes: Sequence[str]) -> DataFrame:
    return table.select("parent", "role", _level().alias("permlevel"), *[F.coalesce(p, F.lit(0)).alias(p) for p in ptypes])


def _governed(custom: DataFrame) -> DataFrame:
    return custom.select("parent").distinct()


def effective_grants(standard: DataFrame, custom: DataFrame, skip_role: str = BOT_ROLE) -> DataFrame:
    """(doctype, role, permlevel, ptype): every grant in force."""
    ptypes = shared_ptypes(standard, custom)
    live = _rows(standard, ptypes).join(_governed(custom), "parent", "left_anti").unionByName(_rows(custom, ptypes))
    flags = F.map_from_arrays(literal_array(ptypes), F.array(*[F.col(p) for p in ptypes]))
    granted = F.map_keys(F.map_filter(flags, lambda _, on: on != 0))
    return (
        live.where(F.col("role") != skip_role)
        .select(F.col("parent").alias("doctype"), "role", "permlevel", F.explode(granted).alias("ptype"))
        .distinct()
    )


def missing_mirror_rows(standard: DataFrame, custom: DataFrame, skip_roles: Sequence[str] = (BOT_ROLE,)) -> DataFrame:
    """Standard rows of governed doctypes without a custom row on (parent, role,
    level)."""
    ptypes = shared_ptypes(standard, custom)
    present = custom.select("parent", "role", _level().alias("permlevel"))
    return (
        _rows(standard, ptypes)
        .where(~F.col("role").isin(list(skip_roles)))
        .join(_governed(custom), "parent", "left_semi")
        .join(present, ["parent", "role", "permlevel"], "left_anti")
    )


def mirror_applied(standard: DataFrame, custom: DataFrame, skip_roles: Sequence[str] = (BOT_ROLE,)) -> DataFrame:
    """Custom rows, with all their columns, and the missing ones appended, with
    null in columns that only custom rows have; existing rows never change."""
    kept = custom.withColumn("permlevel", F.col("permlevel").cast("int"))
    return kept.unionByName(missing_mirror_rows(standard, custom, skip_roles), allowMissingColumns=True)


def permission_levels(doctypes: DataFrame, fields: DataFrame, custom_fields: DataFrame) -> DataFrame:
    """(doctype, permlevel): levels used by fields, and always 0."""
    base = doctypes.select("doctype", F.lit(0).alias("permlevel"))
    own = fields.select("doctype", _level().alias("permlevel"))
    more = custom_fields.select("doctype", _level().alias("permlevel"))
    return base.unionByName(own).unionByName(more).distinct().join(doctypes, "doctype", "left_semi")


def seeded_read_rows(
    doctypes: DataFrame,
    levels: DataFrame,
    standard: DataFrame,
    custom: DataFrame,
    protected: DataFrame,
    role: str = BOT_ROLE,
) -> DataFrame:
    """(target, parent, role, permlevel, <flags>): rows that give the role read
    access wherever it has none yet. Every flag is set; none that writes."""
    ptypes = shared_ptypes(standard, custom)

    def reading(table: DataFrame, name: str) -> DataFrame:
        rows = table.where((F.col("role") == role) & (F.col("read") == 1))
        return rows.select(F.lit(name).alias("target"), F.col("parent").alias("doctype"), _level().alias("permlevel"))

    existing = reading(custom, "custom").unionByName(reading(standard, "standard"))
    governed = _governed(custom).select(F.col("parent").alias("doctype"), F.lit("custom").alias("_t"))
    open_ = doctypes.select("doctype").join(protected, "doctype", "left_anti")
    wanted = (
        levels.join(open_, "doctype", "left_semi")
        .join(governed, "doctype", "left")
        .withColumn("target", F.coalesce("_t", F.lit("standard")))
        .join(existing, ["target", "doctype", "permlevel"], "left_anti")
    )
    return wanted.select(
        "target",
        F.col("doctype").alias("parent"),
        F.lit(role).alias("role"),
        "permlevel",
        *[F.lit(1 if p in READ_PTYPES else 0).alias(p) for p in ptypes],
    )


def lost_grants(before: DataFrame, after: DataFrame) -> DataFrame:
    """Grants in force before and not after."""
    return before.subtract(after)


def missing_roles(has_role: DataFrame, parenttype: str, role: str = BOT_ROLE) -> DataFrame:
    """(parent): restricted reports or pages the role is not listed on."""
    rows = has_role.where(F.col("parenttype") == parenttype)
    return rows.groupBy("parent").agg(F.bool_or(F.col("role") == role).alias("_has")).where(~F.col("_has")).select("parent")


def without_role(table: DataFrame, protected: DataFrame, role: str = BOT_ROLE) -> DataFrame:
    """Rows left after the role's rows were removed, protected doctypes excepted."""
    keep = protected.select(F.col("doctype").alias("parent")).distinct().withColumn("_keep", F.lit(True))
    joined = table.join(keep, "parent", "left")
    return joined.where((F.col("role") != role) | F.col("_keep").isNotNull()).select(*table.columns)


def access_decision(roles: Column, doctype: Column, ptype: Column, newer: bool = False) -> Column:
    """``allow``, ``deny`` or ``neutral``.

    A bot that is no manager may never write what grants access or runs code.
    The newer framework takes anything else but ``allow`` for a denial, so
    there the rest is allowed; in the older one only the bot's reading is.
    """
    bot = F.array_contains(roles, BOT_ROLE) & ~F.array_contains(roles, MANAGER_ROLE)
    escalates = bot & ptype.isin(WRITE_PTYPES) & doctype.isin(ESCALATION_DOCTYPES)
    rest = F.lit("allow") if newer else F.when(bot & ptype.isin(READ_PTYPES), "allow").otherwise("neutral")
    return F.when(escalates, "deny").otherwise(rest)
