"""Document-specific behaviour by (system, target): a registry of hooks.

A hook maps DataFrames to DataFrames and is applied with ``df.transform``. A
plugin overrides only what differs from :class:`ExtractionPlugin`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertally.functions.replies import parse_reply
from papertally.operators import extraction as X

DEFAULT_SYSTEM = "Ledger"
_REGISTRY: dict[tuple[str, str], type[ExtractionPlugin]] = {}


class ExtractionPlugin:
    """The general behaviour, used for every target without its own plugin."""

    system = DEFAULT_SYSTEM
    target_doctype = ""

    def __init__(self, target_doctype: str | None = None):
        self.target_doctype = target_doctype or self.target_doctype

    def header(self, meta: DataFrame) -> DataFrame:
        return X.header_fields(meta.where(F.col("parent") == self.target_doctype))

    def tables(self, books: DataFrame, book_tables: DataFrame) -> DataFrame:
        return X.rule_book_tables(books.where(F.col("target_doctype") == self.target_doctype), book_tables)

    def resolve(self, rows: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
        """Fill header links whose printed text is a known record."""
        return X.match_links(rows, links, targets)

    def transform(self, child_cells: DataFrame) -> DataFrame:
        return child_cells

    def customize(self, target_rows: DataFrame) -> DataFrame:
        return target_rows

    def validate(self, rows: DataFrame) -> DataFrame:
        """(doc, issue): what blocks the creation of a document; none here."""
        return rows.select("doc", F.lit("").alias("issue")).where(F.lit(False))


def register(cls: type[ExtractionPlugin]) -> type[ExtractionPlugin]:
    """Class decorator: file a plugin under its system and target."""
    _REGISTRY[(cls.system, cls.target_doctype)] = cls
    return cls


def has_plugin(target_doctype: str, system: str = DEFAULT_SYSTEM) -> bool:
    return (system, target_doctype) in _REGISTRY


def get_plugin(target_doctype: str, system: str = DEFAULT_SYSTEM) -> ExtractionPlugin:
    """The registered plugin of a target, else the general one."""
    return _REGISTRY.get((system, target_doctype), ExtractionPlugin)(target_doctype)


def extract_document_rows(
    replies: DataFrame,
    plugin: ExtractionPlugin,
    header: DataFrame,
    tables: list[str],
    targets: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Header rows (links resolved) and line rows of (doc, text) replies."""
    parsed = replies.select("doc", parse_reply(F.col("text")).alias("reply"))
    rows = X.header_rows(parsed, header.select("fieldname", "label", "fieldtype", "required"))
    links = header.where(F.col("link_doctype").isNotNull()).select("fieldname", "link_doctype")
    return plugin.resolve(rows, links, targets), X.line_rows(parsed, tables)


def build_documents(
    rows: DataFrame,
    lines: DataFrame,
    plugin: ExtractionPlugin,
    fields: list[str],
    columns: DataFrame,
    links: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target rows, child cells, issues); documents with an issue are left out."""
    issues = plugin.validate(rows)
    fit = issues.select("doc").distinct()
    cells = X.build_child_rows(lines.join(fit, "doc", "left_anti"), columns, links).transform(plugin.transform)
    target = X.build_header(rows.join(fit, "doc", "left_anti"), fields).transform(plugin.customize)
    return target, cells, issues
