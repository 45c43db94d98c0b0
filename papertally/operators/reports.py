"""Scan, status, cost and run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertally.functions.numbers import call_cost, cint, flt
from papertally.functions.replies import redact_images

# The report field used when a table configures none.
DEFAULT_DATE_FIELDS = [{"field": "creation", "type": "Datetime"}]

# The run budget, and what a run that exceeds it says.
RUN_SECONDS = 480
STALE_MESSAGE = "stale — worker died before finalize; superseded by a newer run"


def date_range(
    field: str,
    configured: Sequence[Mapping[str, str]] | None,
    bounds: Mapping[str, str],
) -> Column:
    """Inclusive range on a configured report field.

    The field's configured type picks the bounds (``datetime_start/end`` or
    ``date_start/end``). A date bound on a timestamp column means midnight.
    """
    fields = configured or DEFAULT_DATE_FIELDS
    known = {f["field"].strip(): (f.get("type") or "Date").strip().title() for f in fields if (f.get("field") or "").strip()}
    if field not in known:
        raise ValueError(f"no report date field is named {field!r}")
    prefix = "datetime" if known[field] == "Datetime" else "date"
    start, end = bounds.get(f"{prefix}_start"), bounds.get(f"{prefix}_end")
    if not start or not end:
        raise ValueError(f"the range of {field!r} lacks a start or an end")
    return F.col(field).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def page_count_report(scans: DataFrame, details: DataFrame, targets: DataFrame, in_range: Column) -> DataFrame:
    """Pages per scan and section title of the documents in a date range.

    ``scans``: (name, doctype, docname, scanner_layout, owner, creation,
    modified); ``details``: (scanner_document, title, is_deleted); ``targets``:
    (name, docstatus, <date field>). The range decides first: only pages of its
    scans are counted, per (scan, title), before any other column is attached.
    """
    chosen = targets.where(in_range).select(F.col("name").alias("docname"), "docstatus")
    wanted = scans.join(chosen, "docname", "left_semi").select(F.col("name").alias("scanner_document"))
    pages = (
        details.where(F.col("is_deleted") != 1)
        .select("scanner_document", "title")
        .join(wanted, "scanner_document", "left_semi")
        .groupBy("scanner_document", "title")
        .agg(F.count(F.lit(1)).alias("page_count"))
    )
    return (
        scans.join(chosen, "docname")
        .join(pages, F.col("name") == F.col("scanner_document"))
        .select(
            F.col("doctype").alias("document_type"),
            "docname",
            F.col("scanner_layout").alias("layout"),
            "page_count",
            "title",
            "docstatus",
            F.col("name").alias("scan_name"),
            F.col("owner").alias("created_by"),
            "creation",
            "modified",
        )
    )


def scan_pages(details: DataFrame, scans: DataFrame, files: DataFrame) -> DataFrame:
    """Live pages of known scans with their file; several files with one url
    give several rows."""
    return (
        details.where(F.col("is_deleted") == 0)
        .join(scans.select(F.col("name").alias("scanner_document")), "scanner_document", "left_semi")
        .join(files.select(F.col("name").alias("file_name"), "file_url", "file_type"), F.col("attachment") == F.col("file_url"), "left")
        .drop("file_url")
    )


def upload_status(
    documents: DataFrame, scanned: DataFrame, in_range: Column, view: str = "All", key: str = "name"
) -> DataFrame:
    """Documents with ``is_scanned``; ``view`` is All, Scanned or Not Scanned.

    ``scanned``: (docname). Filtered views are semi and anti joins.
    """
    rows = documents.where((F.col("docstatus") < 2) & in_range)
    match = rows[key] == scanned["docname"]
    if view == "Scanned":
        return rows.join(scanned, match, "left_semi").withColumn("is_scanned", F.lit(1))
    if view == "Not Scanned":
        return rows.join(scanned, match, "left_anti").withColumn("is_scanned", F.lit(0))
    keys = scanned.select(F.col("docname").alias("_k")).distinct()
    joined = rows.join(keys, rows[key] == keys["_k"], "left")
    return joined.withColumn("is_scanned", F.col("_k").isNotNull().cast("int")).drop("_k")


def costed_calls(calls: DataFrame, models: DataFrame) -> DataFrame:
    """Calls with ``cost_usd`` and ``cost_estimated`` from usage and rate card.

    ``calls``: (..., ai_model, status, cost, prompt_tokens, completion_tokens);
    ``models``: (name, cost_per_m_input, cost_per_m_output).
    """
    rates = models.select(F.col("name").alias("ai_model"), "cost_per_m_input", "cost_per_m_output")
    priced = calls.join(rates, "ai_model", "left").withColumn(
        "_c",
        call_cost(
            F.col("cost"), F.col("prompt_tokens"), F.col("completion_tokens"),
            F.col("cost_per_m_input"), F.col("cost_per_m_output"), F.col("status"),
        ),
    )
    return priced.select(
        *[c for c in calls.columns if c != "cost"],
        F.col("_c.cost").alias("cost_usd"),
        F.col("_c.estimated").alias("cost_estimated"),
    )


def run_totals(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs with tokens, cost and estimate flag summed from their calls."""
    sums = calls.groupBy("run").agg(
        F.sum("total_tokens").alias("_t"), F.sum("cost_usd").alias("_c"), F.max("cost_estimated").alias("_e")
    )
    joined = runs.join(sums, runs["name"] == sums["run"], "left")
    return joined.select(
        runs["*"],
        F.coalesce("_t", F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce("_c", F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce("_e", F.lit(0)).cast("int").alias("cost_estimated"),
    )


def run_trace(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per call of each run (a run without calls has one row), to be
    read in order of (run, creation)."""
    fields = ["purpose", "ai_model", "status", "latency_ms", "total_tokens", "cost_usd", "error_message"]
    traced = calls.select(
        F.col("run").alias("_run"),
        F.col("name").alias("call"),
        F.col("creation").alias("call_creation"),
        *[F.col(c).alias(f"call_{c}") for c in fields if c in calls.columns],
    )
    return runs.join(traced, runs["name"] == traced["_run"], "left").drop("_run")


def mark_stale_runs(runs: DataFrame, now: Column, budget_seconds: Column | int | None = None) -> DataFrame:
    """Runs still ``Running`` after twice their budget become ``Failed``; only
    runs on a reference are marked."""
    budget = cint(F.lit(budget_seconds) if not isinstance(budget_seconds, Column) else budget_seconds)
    budget = F.when(budget == 0, F.lit(RUN_SECONDS)).otherwise(budget)
    sooner = F.col("started_at").cast("timestamp") < F.timestamp_micros(
        F.unix_micros(now.cast("timestamp")) - (budget * 2 * 1000000)
    )
    stale = F.coalesce((F.col("status") == "Running") & (F.coalesce("reference_name", F.lit("")) != "") & sooner, F.lit(False))
    replaced = {
        "status": F.when(stale, "Failed").otherwise(F.col("status")),
        "error_message": F.when(stale, STALE_MESSAGE).otherwise(F.col("error_message")),
        "ended_at": F.when(stale, now.cast(runs.schema["ended_at"].dataType)).otherwise(F.col("ended_at")),
    }
    return runs.select(*[replaced.get(c, F.col(c)).alias(c) for c in runs.columns])


def extraction_bundle(
    pages: DataFrame, rows: DataFrame, header: DataFrame, lines: DataFrame, default_table: DataFrame
) -> dict[str, DataFrame]:
    """The parts of an extraction as a reviewer sees it, one DataFrame each.

    ``pages`` (doc, page_no, width, height, ...) with numbers read leniently and
    ``place``, their order in the document (pages of one number by their
    other columns); ``rows`` (doc, fieldname, confidence,
    source_page, ...) joined with their schema ``header`` (fieldname, choices,
    link_doctype, required), fields unknown to it being optional; ``lines`` (doc,
    table, row_no, ...) with the document's ``default_table`` (doc, line_table)
    filled in; and the declared tables in the order of their first line. Columns
    beyond these stay as they are.
    """
    lenient = lambda df, of, names: df.withColumns({n: of(F.col(n)) for n in names if n in df.columns})
    paged = lenient(pages, cint, ["page_no", "width", "height"])
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("doc", "page_no")]
    by_number = Window.partitionBy("doc").orderBy("page_no", *rest)
    own = header.select("fieldname", "choices", "link_doctype", "required")
    fields = rows.join(own, "fieldname", "left").withColumn("required", F.coalesce("required", F.lit(False)))
    fields = lenient(lenient(fields, flt, ["confidence"]), cint, ["source_page"])
    table = F.coalesce(F.nullif(F.col("table"), F.lit("")), F.col("line_table"))
    named = lines.join(default_table, "doc", "left").withColumn("table", table).drop("line_table")
    named = lenient(lenient(named, flt, ["qty", "rate", "amount", "match_confidence"]), cint, ["row_no", "source_page"])
    declared = named.where(F.coalesce("table", F.lit("")) != "").groupBy("doc", "table").agg(F.min("row_no").alias("first_row"))
    return {
        "pages": paged.withColumn("place", F.row_number().over(by_number)),
        "fields": fields,
        "lines": named,
        "tables": declared,
    }


def call_log_rows(calls: DataFrame) -> DataFrame:
    """Call rows as they are logged: images redacted, numbers filled, texts whole."""
    numbers = ["prompt_tokens", "completion_tokens", "total_tokens", "cost_estimated"]
    replaced = {
        "request_payload": redact_images(F.col("request_payload")),
        "response_payload": F.col("response_payload"),
        "error_message": F.coalesce("error_message", F.lit("")),
        "cost_usd": flt(F.col("cost_usd")),
        **{n: cint(F.col(n)) for n in numbers},
    }
    return calls.select(*[replaced.get(c, F.col(c)).alias(c) for c in calls.columns])


def page_boxes(rows: DataFrame, page: int, default_page: int | None = 1) -> DataFrame:
    """Rows with a box on one page; a missing page number means
    ``default_page`` (``None``: such rows belong to no page)."""
    own = F.col("source_page") if default_page is None else F.coalesce("source_page", F.lit(default_page))
    return rows.where(F.col("bbox").isNotNull() & (own == page))


def role_violations(action_models: DataFrame, models: DataFrame, needs_vision: DataFrame) -> DataFrame:
    """(action, violation) for the models linked to each action.

    ``action_models``: (action, ai_model, is_orchestrator, is_verifier);
    ``models``: (name, enabled, supports_vision); ``needs_vision``: (action) of
    actions with a key that requires a box.
    """
    info = models.select(F.col("name").alias("ai_model"), "enabled", "supports_vision")
    joined = action_models.join(info, "ai_model", "left")
    boxed = needs_vision.select("action").distinct().withColumn("_boxed", F.lit(True))

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) != 0

    per_action = (
        joined.groupBy("action")
        .agg(
            F.count_if(flag("is_orchestrator")).alias("n_orchestrators"),
            F.count_if(flag("is_verifier")).alias("n_verifiers"),
            F.count_if(~flag("enabled")).alias("n_disabled"),
            F.count_if(flag("supports_vision")).alias("n_vision"),
        )
        .join(boxed, "action", "left")
    )
    checks = F.array_compact(
        F.array(
            F.when(F.col("n_orchestrators") != 1, F.lit("exactly one orchestrator")),
            F.when(F.col("n_verifiers") > 1, F.lit("at most one verifier")),
            F.when(F.col("n_disabled") > 0, F.lit("disabled model")),
            F.when(F.coalesce("_boxed", F.lit(False)) & (F.col("n_vision") == 0), F.lit("no vision model")),
        )
    )
    return per_action.select("action", F.explode(checks).alias("violation"))

