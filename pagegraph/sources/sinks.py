"""Sinks: page JSON, sidecar files, bundles, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PAGE

VERSION = "1.1"


def pages_json(items: DataFrame) -> DataFrame:
    """One JSON text per page: page_number and content in reading order (a page at a time, never a document)."""
    fields = [c for c in ("type", "text", "font_size", "metadata") if c in items.columns]
    content = F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), lambda s: F.struct(*(s[c].alias(c) for c in fields)))
    pages = items.groupBy(*PAGE).agg(content.alias("content"))
    return pages.select(*PAGE, F.to_json(F.struct("page_number", "content")).alias("json"))


def write_pages(items: DataFrame, path: str) -> None:
    pages_json(items).select("doc_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_sidecars(numbered: DataFrame, path: str) -> None:
    """One folder per document, one JSON line per numbered item."""
    numbered.write.mode("overwrite").partitionBy("doc_id").json(path)


def write_bundle(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.withColumn("v", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.withColumn("v", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/edges")


def write_html(html: DataFrame, path: str) -> None:
    html.select("doc_id", F.col("html").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
