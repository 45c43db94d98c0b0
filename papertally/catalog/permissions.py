"""Permission tables and dashboards.

Nations are roles, customers doctypes: a customer has a standard row for its
own nation and, by its orders, custom ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.catalog.registry import ORACLE, Tables, query
from papertally.operators import dashboards as D
from papertally.operators import perms as P


def _role(c) -> object:
    return F.when(c % 25 == 7, P.BOT_ROLE).otherwise(F.concat(F.lit("R"), c % 25))


def standard(t: Tables) -> DataFrame:
    """Supplier parts as standard rows: one per (part, supplier's nation)."""
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_partkey", "s_nationkey", "l_linenumber")
    pairs = rows.agg(F.min("l_quantity").alias("q"))
    return pairs.groupBy("l_partkey", "s_nationkey").agg(F.min("q").alias("q"), F.min("l_linenumber").alias("n")).select(
        F.concat(F.lit("D"), "l_partkey").alias("parent"),
        _role(F.col("s_nationkey")).alias("role"),
        F.when(F.col("n") > 1, F.col("n") % 2).alias("permlevel"),
        F.lit(1).alias("read"),
        (F.col("q") % 2 == 0).cast("int").alias("write"),
        F.when(F.col("q") % 3 == 0, 1).alias("submit"),
        F.lit(1).alias("only_here"),
    )


def custom(t: Tables) -> DataFrame:
    """Every third part has custom rows."""
    return t.part.where(F.col("p_partkey") % 3 == 0).select(
        F.concat(F.lit("D"), "p_partkey").alias("parent"),
        _role(F.col("p_size")).alias("role"),
        F.lit(None).cast("int").alias("permlevel"),
        (F.col("p_size") % 2).alias("read"),
        F.lit(0).alias("write"),
        F.lit(1).alias("submit"),
    )


_ROWS = """
    std AS (
      SELECT 'D' || l_partkey AS parent, CASE WHEN s_nationkey % 25 = 7 THEN 'AI Bot' ELSE 'R' || (s_nationkey % 25) END AS role,
             CASE WHEN min(l_linenumber) > 1 THEN min(l_linenumber) % 2 ELSE 0 END AS permlevel, 1 AS read,
             CASE WHEN min(l_quantity) % 2 = 0 THEN 1 ELSE 0 END AS write, CASE WHEN min(l_quantity) % 3 = 0 THEN 1 ELSE 0 END AS submit
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, s_nationkey),
    cus AS (
      SELECT 'D' || p_partkey AS parent, CASE WHEN p_size % 25 = 7 THEN 'AI Bot' ELSE 'R' || (p_size % 25) END AS role, 0 AS permlevel,
             p_size % 2 AS read, 0 AS write, 1 AS submit
      FROM part WHERE p_partkey % 3 = 0),
    missing AS (
      SELECT * FROM std s WHERE role <> 'AI Bot' AND parent IN (SELECT parent FROM cus)
        AND NOT EXISTS (SELECT 1 FROM cus c WHERE c.parent = s.parent AND c.role = s.role AND c.permlevel = s.permlevel)),
    live AS (SELECT * FROM std WHERE parent NOT IN (SELECT parent FROM cus) UNION ALL SELECT * FROM cus),
    grants AS (
      SELECT parent AS doctype, role, permlevel, 'read' AS ptype FROM live WHERE read = 1 AND role <> 'AI Bot'
      UNION SELECT parent, role, permlevel, 'write' FROM live WHERE write = 1 AND role <> 'AI Bot'
      UNION SELECT parent, role, permlevel, 'submit' FROM live WHERE submit = 1 AND role <> 'AI Bot')
    """


@query("perms_effective", "WITH" + _ROWS + "SELECT * FROM grants")
def perms_effective(t: Tables) -> DataFrame:
    return P.effective_grants(standard(t), custom(t))


@query("perms_missing", "WITH" + _ROWS + "SELECT * FROM missing")
def perms_missing(t: Tables) -> DataFrame:
    return P.missing_mirror_rows(standard(t), custom(t)).select("parent", "role", "permlevel", "read", "write", "submit")


@query("perms_mirrored", "WITH" + _ROWS + "SELECT parent, role, permlevel, read, write, submit FROM cus UNION ALL SELECT * FROM missing")
def perms_mirrored(t: Tables) -> DataFrame:
    rows = P.mirror_applied(standard(t), custom(t)).select("parent", "role", "permlevel", "read", "write", "submit")
    return rows.withColumn("permlevel", F.coalesce("permlevel", F.lit(0)))


@query(
    "perms_regressions",
    "WITH" + _ROWS + """
    , after AS (
      SELECT parent AS doctype, role, permlevel, 'read' AS ptype FROM std WHERE read = 1 AND role <> 'AI Bot' AND parent NOT IN (SELECT parent FROM cus)
      UNION SELECT parent, role, permlevel, 'submit' FROM cus WHERE submit = 1 AND role <> 'AI Bot')
    SELECT * FROM grants EXCEPT SELECT * FROM after
    """,
)
def perms_regressions(t: Tables) -> DataFrame:
    """Afterwards: standard rows only read, custom rows only submit."""
    after_std = standard(t).withColumn("write", F.lit(0)).withColumn("submit", F.lit(0))
    after_cus = custom(t).withColumn("read", F.lit(0))
    return P.lost_grants(P.effective_grants(standard(t), custom(t)), P.effective_grants(after_std, after_cus))


_LEVELS = """
    , levels AS (
      SELECT 'D' || p_partkey AS doctype, 0 AS permlevel FROM part
      UNION SELECT 'D' || l_partkey, l_linenumber % 3 FROM lineitem WHERE l_returnflag = 'A'
      UNION SELECT 'D' || l_partkey, 5 FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)
    """


def _levels(t: Tables) -> tuple[DataFrame, DataFrame]:
    doctypes = t.part.select(F.concat(F.lit("D"), "p_partkey").alias("doctype"))
    own = t.lineitem.where(F.col("l_returnflag") == "A").select(
        F.concat(F.lit("D"), "l_partkey").alias("doctype"), (F.col("l_linenumber") % 3).alias("permlevel")
    )
    more = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).select(
        F.concat(F.lit("D"), "l_partkey").alias("doctype"), F.lit(5).alias("permlevel")
    )
    return doctypes, P.permission_levels(doctypes, own, more)


@query("perms_levels", "WITH" + _ROWS + _LEVELS + "SELECT doctype, permlevel FROM levels")
def perms_levels(t: Tables) -> DataFrame:
    return _levels(t)[1]


@query(
    "perms_seeding",
    "WITH" + _ROWS + _LEVELS + """
    , wanted AS (SELECT *, CASE WHEN doctype IN (SELECT parent FROM cus) THEN 'custom' ELSE 'standard' END AS target FROM levels
                 WHERE doctype NOT IN (SELECT 'D' || p_partkey FROM part WHERE p_type = 'PROMO'))
    SELECT target, doctype AS parent, 'AI Bot' AS role, permlevel, 1 AS read, 0 AS write, 0 AS submit FROM wanted w
    WHERE NOT EXISTS (SELECT 1 FROM cus c WHERE w.target = 'custom' AND c.parent = w.doctype AND c.permlevel = w.permlevel AND c.role = 'AI Bot' AND c.read = 1)
      AND NOT EXISTS (SELECT 1 FROM std s WHERE w.target = 'standard' AND s.parent = w.doctype AND s.permlevel = w.permlevel AND s.role = 'AI Bot' AND s.read = 1)
    """,
)
def perms_seeding(t: Tables) -> DataFrame:
    doctypes, levels = _levels(t)
    protected = t.part.where(F.col("p_type") == "PROMO").select(F.concat(F.lit("D"), "p_partkey").alias("doctype"))
    rows = P.seeded_read_rows(doctypes, levels, standard(t), custom(t), protected)
    return rows.select("target", "parent", "role", "permlevel", "read", "write", "submit")


@query(
    "missing_roles",
    """
    SELECT DISTINCT l_orderkey AS parent FROM lineitem WHERE l_returnflag = 'A'
    EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 25 = 7
    """,
)
def missing_roles(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("parent"),
        F.when(F.col("l_returnflag") == "A", "Report").otherwise("Page").alias("parenttype"),
        _role(F.col("l_suppkey")).alias("role"),
    )
    return P.missing_roles(rows, "Report")


@query(
    "guarded_cleanup",
    "WITH" + _ROWS + """
    SELECT parent, role FROM std WHERE role <> 'AI Bot' OR parent IN (SELECT 'D' || p_partkey FROM part WHERE p_type = 'PROMO')
    """,
)
def guarded_cleanup(t: Tables) -> DataFrame:
    protected = t.part.where(F.col("p_type") == "PROMO").select(F.concat(F.lit("D"), "p_partkey").alias("doctype"))
    return P.without_role(standard(t), protected).select("parent", "role")


@query(
    "access_audit",
    """
    SELECT l_orderkey, l_partkey, l_suppkey,
           CASE WHEN bot AND wr AND dt = 'User' THEN 'deny' WHEN bot AND NOT wr THEN 'allow' ELSE 'neutral' END AS older,
           CASE WHEN bot AND wr AND dt = 'User' THEN 'deny' ELSE 'allow' END AS newer
    FROM (SELECT *, l_linenumber % 2 = 0 AND l_returnflag <> 'R' AS bot, l_linestatus = 'O' AS wr,
                 CASE WHEN l_suppkey % 2 = 0 THEN 'User' ELSE 'Sales Invoice' END AS dt FROM lineitem) q
    """,
)
def access_audit(t: Tables) -> DataFrame:
    bot = F.when(F.col("l_linenumber") % 2 == 0, F.lit(P.BOT_ROLE)).otherwise("Sales User")
    roles = F.array(bot, F.when(F.col("l_returnflag") == "R", F.lit(P.MANAGER_ROLE)).otherwise("Guest"))
    doctype = F.when(F.col("l_suppkey") % 2 == 0, "User").otherwise("Sales Invoice")
    ptype = F.when(F.col("l_linestatus") == "O", "write").otherwise("read")
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        P.access_decision(roles, doctype, ptype).alias("older"),
        P.access_decision(roles, doctype, ptype, newer=True).alias("newer"),
    )


def _boards(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("name"),
        F.concat(F.lit("u"), "s_nationkey").alias("owner"),
        (F.col("s_acctbal") > 1000).cast("int").alias("enabled"),
        (F.col("s_suppkey") % 4 != 0).cast("int").alias("require_auth"),
        F.col("s_acctbal").alias("modified"),
    )


def _listed(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("parent"), F.concat(F.lit("u"), F.col("l_partkey") % 40).alias("user"))


@query(
    "dashboards_visible",
    """
    SELECT s_suppkey AS name, s_acctbal AS modified FROM supplier WHERE s_acctbal > 1000
      AND (s_nationkey = 3 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey % 40 = 3))
    """,
)
def dashboards_visible(t: Tables) -> DataFrame:
    return D.visible_dashboards(_boards(t), _listed(t), "u3").select("name", "modified")


@query(
    "dashboards_of_each",
    """
    SELECT 'u' || s_nationkey AS "user", s_suppkey AS name FROM supplier WHERE s_acctbal > 1000
    UNION SELECT 'u' || (l_partkey % 40), l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 1000
    """,
)
def dashboards_of_each(t: Tables) -> DataFrame:
    return D.visible_to_each(_boards(t), _listed(t))


@query(
    "dashboard_access",
    """
    SELECT o_orderkey AS request, CASE WHEN o_custkey % 60 = 50 THEN 'Guest' ELSE 'u' || (o_custkey % 60) END AS "user", s_suppkey AS name,
           CASE WHEN s_acctbal <= 1000 THEN false WHEN s_suppkey % 4 = 0 THEN true WHEN o_custkey % 60 = 50 THEN false
                WHEN o_custkey % 60 = s_nationkey OR o_orderstatus = 'P' THEN true
                ELSE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey % 40 = o_custkey % 60) END AS allowed
    FROM orders JOIN supplier ON s_suppkey = o_orderkey % 100
    """,
)
def dashboard_access(t: Tables) -> DataFrame:
    return _access(t, F.col("o_orderkey") % 100)


@query(
    "dashboard_access_whole",
    ORACLE["dashboard_access"].replace("s_suppkey = o_orderkey % 100", "s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)"),
)
def dashboard_access_whole(t: Tables) -> DataFrame:
    """The same with a request of every order, over all suppliers' boards."""
    return _access(t, F.col("o_orderkey") % t.supplier.count())


def _access(t: Tables, name: Column) -> DataFrame:
    user = F.when(F.col("o_custkey") % 60 == 50, "Guest").otherwise(F.concat(F.lit("u"), F.col("o_custkey") % 60))
    requests = t.orders.select(
        F.col("o_orderkey").alias("request"), user.alias("user"), name.alias("name"), (F.col("o_orderstatus") == "P").alias("is_manager")
    )
    return D.access_checks(requests, _boards(t), _listed(t))
