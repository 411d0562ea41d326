"""Document-level passes: running headers, image context, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, PAGE, Layout
from ..functions.text import strip_ws, without_digits


def _norm(text):
    return strip_ws(without_digits(F.coalesce(text, F.lit(""))))


def exclusion_zones(items: DataFrame, pages: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Texts without digits that occur on (about) every page: doc_id, zone, n. ``pages`` counts empty pages too."""
    n_pages = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= cfg.zone_pages)
    t = items.where(F.col("type").isin("heading", "paragraph")).select("doc_id", _norm(F.col("text")).alias("zone"))
    t = t.where((F.length("zone") > 0) & (F.length("zone") < cfg.zone_length)).groupBy("doc_id", "zone").agg(F.count("*").alias("n"))
    return t.join(n_pages, "doc_id").where(F.col("n") >= cfg.zone_share * F.col("n_pages")).select("doc_id", "zone", "n")


def strip_exclusion(items: DataFrame, zones: DataFrame) -> DataFrame:
    return items.withColumn("zone", _norm(F.col("text"))).join(zones.select("doc_id", "zone"), ["doc_id", "zone"], "left_anti").drop("zone")


def semantic_link(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Text above and below each image of the same page, for images with some; above goes first."""
    has_box = F.col("x0").isNotNull()
    img = items.where((F.col("type") == "image") & has_box).select(*PAGE, F.col("ord").alias("image_ord"), *(F.col(c).alias(f"i_{c}") for c in ("x0", "top", "x1", "bottom")))
    txt = items.where(F.col("type").isin("heading", "paragraph") & has_box).select(*PAGE, "ord", "text", "x0", "top", "x1", "bottom")
    tol = cfg.link_tolerance
    overlap = (F.col("x0") < F.col("i_x1") + tol) & (F.col("x1") > F.col("i_x0") - tol)
    up, down = F.col("i_top") - F.col("bottom"), F.col("top") - F.col("i_bottom")
    above, below = up.between(-cfg.link_overlap, cfg.link_margin), down.between(-cfg.link_overlap, cfg.link_margin)
    j = img.join(txt, PAGE).where(overlap & (above | below)).withColumn("side", F.when(above, "a").otherwise("b"))

    def joined(side: str):
        return strip_ws(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ord", "text")))), lambda s: F.coalesce(s["text"], F.lit(""))), "\n"))

    return j.groupBy(*PAGE, "image_ord").agg(joined("a").alias("text_above"), joined("b").alias("text_below"))


def doc_heading_threshold(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Per document: mode of the text items' sizes plus 1.5 deviations, or the default without sizes."""
    sized = items.where(F.col("type").isin("heading", "paragraph"))
    size = F.nullif("font_size", F.lit(0.0))
    counts = sized.groupBy("doc_id", size.alias("s")).agg(F.count("*").alias("c"), F.min(F.struct("page_number", "ord")).alias("first"))
    place = F.struct(F.col("c"), -F.col("first.page_number"), -F.col("first.ord"))
    n, t, q = F.sum(F.when(F.col("s").isNotNull(), F.col("c"))), F.sum(F.col("c") * F.col("s")), F.sum(F.col("c") * F.col("s") * F.col("s"))
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - t * t / n) / F.greatest(n - 1, F.lit(1))))).otherwise(0.0)
    per = counts.groupBy("doc_id").agg((F.max_by("s", F.when(F.col("s").isNotNull(), place)) + cfg.doc_heading_sd * sd).alias("t"))
    docs = items.select("doc_id").distinct()
    return docs.join(per, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit(cfg.doc_heading_default)).alias("threshold"))


def promote(items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``node_type``: headings, and text as large as the document's headings."""
    i = items.join(thresholds, "doc_id")
    text = F.col("type").isin("heading", "paragraph")
    return i.withColumn("node_type", F.when(text & ((F.col("type") == "heading") | (F.coalesce("font_size", F.lit(0.0)) >= F.col("threshold"))), "heading").otherwise(F.col("type"))).drop("threshold")


def numbered(items: DataFrame, kind: str) -> DataFrame:
    """Items of one type with ``n``: their number in the document, in page and reading order."""
    return items.where(F.col("type") == kind).withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("page_number", "ord")))
