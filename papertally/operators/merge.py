"""Mail merge: data rows, rendered messages, delivery status."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertally.functions.text import render_template


@dataclass(frozen=True)
class MergeJob:
    """What a data builder sends."""

    name: str
    target_field: str
    subject: str
    body: str
    sender: str | None = None
    cc: str | None = None
    bcc: str | None = None
    attachment_naming_field: str | None = None


def merge_rows(rows: DataFrame, constants: Mapping[str, str]) -> DataFrame:
    """Rows overlaid with global constants; constants win, empty keys are skipped."""
    return rows.withColumns({k: F.lit(v) for k, v in constants.items() if k})


def rendered(rows: DataFrame, subject: str, body: str) -> DataFrame:
    """Rows with the rendered ``email_subject`` and ``email_body``."""
    values = {c: F.col(c) for c in rows.columns}
    return rows.withColumns({"email_subject": render_template(subject, values), "email_body": render_template(body, values)})


def share_log(rows: DataFrame, job: MergeJob, user: str) -> DataFrame:
    """One ``Pending`` log row per data row, with its arguments, its data and
    the rendered message."""

    def text(value: str | None) -> Column:
        return F.lit(value).cast("string")

    recipient = F.col(job.target_field) if job.target_field in rows.columns else F.lit(None)
    args = F.to_json(
        F.struct(
            text(job.sender).alias("from_email"),
            recipient.cast("string").alias("to"),
            text(job.cc).alias("cc"),
            text(job.bcc).alias("bcc"),
            text(job.subject).alias("subject"),
        )
    )
    data = F.to_json(F.struct(*rows.columns))
    naming = job.attachment_naming_field
    named = F.col(naming).cast("string") if naming in rows.columns else F.lit(job.name)
    messages = rendered(rows, job.subject, job.body)
    return messages.select(
        *rows.columns,
        F.lit(job.name).alias("data_builder"),
        F.lit("Pending").alias("log_status"),
        F.lit(user).alias("user"),
        F.lit("Email").alias("share_type"),
        args.alias("args"),
        data.alias("format_data"),
        "email_subject",
        "email_body",
        F.concat(F.coalesce(named, F.lit("None")), F.lit(".pdf")).alias("attachment_name"),
    )


def share_outcome(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending rows after sending: ``Processing`` with a queue row, or
    ``Failed`` with an error. ``outcomes``: (name, email_queue, error)."""
    sent = outcomes.select("name", F.col("email_queue").alias("_queue"), F.col("error").alias("_error"), F.lit(True).alias("_done"))
    joined = log.join(sent, "name", "left")
    pending = (F.col("log_status") == "Pending") & F.col("_done").isNotNull()
    failed = F.col("_error").isNotNull()
    replaced = {
        "log_status": F.when(pending, F.when(failed, "Failed").otherwise("Processing")).otherwise(F.col("log_status")),
        "email_queue": F.when(pending & ~failed, F.col("_queue")).otherwise(F.col("email_queue")),
        "error_log": F.when(pending & failed, F.col("_error")).otherwise(F.col("error_log")),
    }
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in log.columns])


# Queue states that say nothing yet.
QUEUE_WAITING = ["Not Sent", "Sending"]


def sync_delivery(log: DataFrame, queue: DataFrame) -> DataFrame:
    """Log after a look at the mail queue (name, status).

    Processing mails without a queue row, or with one that waits, stay; a sent
    one succeeds; any other state, a missing one included, fails.
    """
    states = queue.select(F.col("name").alias("_q"), F.col("status").alias("_state"))
    joined = log.join(states, log["email_queue"] == states["_q"], "left")
    asked = (F.col("log_status") == "Processing") & (F.col("share_type") == "Email") & F.col("_q").isNotNull()
    now = (
        F.when(F.col("_state").isin(QUEUE_WAITING), F.col("log_status"))
        .when(F.col("_state") == "Sent", "Success")
        .otherwise("Failed")
    )
    status = F.when(asked, now).otherwise(F.col("log_status"))
    return joined.select(*[status.alias(c) if c == "log_status" else log[c] for c in log.columns])
