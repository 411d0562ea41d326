"""Glyph-level operators: zones, angles, corruption, page metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PAGE, Layout
from ..functions.text import rotation_angle


def safe_zone(glyphs: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Glyphs strictly inside the vertical safe zone (a plain predicate, so a scan can take it over)."""
    return glyphs.where((F.col("top") > cfg.safe_top * F.col("page_height")) & (F.col("top") < cfg.safe_bottom * F.col("page_height")))


def with_angle(glyphs: DataFrame) -> DataFrame:
    return glyphs.withColumn("angle", rotation_angle(F.col("matrix")))


def normalised(glyphs: DataFrame) -> DataFrame:
    """nx0, nx1, ntop, nbottom: the glyph's centre turned back about the origin, its extent kept."""
    turn = F.radians(-F.col("angle"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    nx, ny = cx * F.cos(turn) - cy * F.sin(turn), cx * F.sin(turn) + cy * F.cos(turn)
    w, h = F.col("width") / 2, F.abs(F.col("bottom") - F.col("top")) / 2
    level = F.col("angle") == 0

    def pick(plain: str, turned: Column) -> Column:
        return F.when(level, F.col(plain)).otherwise(turned)

    return glyphs.withColumns({"nx0": pick("x0", nx - w), "nx1": pick("x1", nx + w), "ntop": pick("top", ny - h), "nbottom": pick("bottom", ny + h)})


def cid_pages(glyphs: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Per page: length of its text, length without ``(cid:n)``, and whether it is corrupt."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "")
    pages = glyphs.groupBy(*PAGE).agg(text.alias("t"))
    n, clean = F.length("t"), F.length(F.regexp_replace("t", r"\(cid:\d+\)", ""))
    return pages.select(*PAGE, n.alias("n_chars"), clean.alias("n_clean"), (F.contains(F.col("t"), F.lit("(cid:")) & (n > cfg.cid_min_length) & (clean / n < cfg.cid_clean_share)).alias("corrupt"))


def page_metrics(glyphs: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Per page and angle: mode_size (ties to the first met), avg_height, sd_size, heading_threshold."""
    size = F.bround("size", 1)
    by_size = glyphs.groupBy(*PAGE, "angle", size.alias("s")).agg(F.count("*").alias("c"), F.min("seq").alias("first"), F.sum(F.abs(F.col("bottom") - F.col("top"))).alias("h"))
    n, total, squares = F.sum("c"), F.sum(F.col("c") * F.col("s")), F.sum(F.col("c") * F.col("s") * F.col("s"))
    out = by_size.groupBy(*PAGE, "angle").agg(
        F.max_by("s", F.struct("c", -F.col("first"))).alias("mode_size"),
        (F.sum("h") / n).alias("avg_height"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / F.greatest(n - 1, F.lit(1))))).otherwise(0.0).alias("sd_size"),
        n.alias("n_glyphs"),
        F.min("first").alias("first_seq"),
    )
    high = F.when(F.col("sd_size") > cfg.heading_min_sd, F.col("mode_size") + cfg.heading_sd * F.col("sd_size")).otherwise(F.col("mode_size") * cfg.heading_mode)
    return out.withColumn("heading_threshold", high)
