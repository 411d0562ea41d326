"""Tables: validity, page space, fallback reading, healing across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PAGE
from ..functions.text import strip_ws, word_count


def validity(tables: DataFrame) -> DataFrame:
    """``valid`` for ``data`` (array of rows of cells), by higher-order functions over the array: nothing is exploded."""
    cells = F.transform(F.flatten("data"), lambda c: strip_ws(c))
    counts = F.transform(F.filter(cells, lambda c: c != ""), word_count)
    t = tables.withColumns({"_rows": F.size("data"), "_cols": F.coalesce(F.size(F.try_element_at("data", F.lit(1))), F.lit(0)), "_cells": cells, "_words": counts})

    def mean_words(i: int):
        per_row = F.transform("data", lambda r: word_count(F.coalesce(F.try_element_at(r, F.lit(i)), F.lit(""))))
        return F.aggregate(per_row, F.lit(0), lambda a, x: a + x) / F.col("_rows")

    total = F.col("_rows") * F.col("_cols")
    most = F.coalesce(F.array_max("_words"), F.lit(0))
    rejected_pair = (F.col("_cols") == 2) & (((mean_words(1) < 2) & (most > 20)) | ((mean_words(1) <= 1.2) & (mean_words(2) <= 1.2) & (F.col("_rows") > 5)))
    empty = F.size(F.filter("_cells", lambda c: c == ""))
    ok = (F.col("_rows") > 0) & (total > 1) & (F.col("_cols") > 1) & (F.size("_words") >= 2)
    # the share and means are only asked for once the counts are known to be positive
    fine = F.when(~ok, False).otherwise((empty <= 0.8 * total) & ~rejected_pair)
    return t.withColumns({"n_rows": F.col("_rows"), "n_cols": F.col("_cols"), "n_empty": empty, "max_words": most, "valid": fine}).drop("_rows", "_cols", "_cells", "_words")


def flip(tables: DataFrame) -> DataFrame:
    """``top`` and ``bottom`` from bottom-up y0, y1."""
    return tables.withColumns({"top": F.col("page_height") - F.col("y1"), "bottom": F.col("page_height") - F.col("y0")})


def probe(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages that have ruled structure at all: only these reach an expensive reader."""
    return pages.join(rules.select(*PAGE), PAGE, "left_semi")


def with_fallback(lattice: DataFrame, stream: DataFrame) -> DataFrame:
    """Lattice tables, and stream tables of pages without any."""
    return lattice.unionByName(stream.join(lattice.select(*PAGE).distinct(), PAGE, "left_anti"))


def gutter_columns(gutters: DataFrame) -> DataFrame:
    """Column separators of a page: the gutters' middles with one decimal, in order."""
    middles = F.transform(F.array_sort(F.collect_list(F.struct("g0", "g1"))), lambda g: F.format_string("%.1f", g["g0"] + (g["g1"] - g["g0"]) / 2))
    return gutters.groupBy(*PAGE).agg(F.array_join(middles, ",").alias("columns"))


def heal(pages: DataFrame) -> DataFrame:
    """Which pages' last table takes in the next page's first table.

    ``pages``: doc_id, page_number, n_items, first_is_table, last_is_table, first_cols, last_cols, first_header,
    last_header, first_rows, last_rows. Going left to right, a page with one item that was just moved up cannot
    merge on: in a chain of candidates linked by such pages every other one merges.
    """
    order = W.partitionBy("doc_id").orderBy("page_number")
    p = pages.withColumn("_next", F.lead(F.struct("page_number", "first_is_table", "first_cols", "first_header", "first_rows")).over(order))
    fits = F.col("last_is_table") & F.col("_next.first_is_table") & (F.col("last_cols") == F.col("_next.first_cols")) & (F.col("last_cols") > 0)
    p = p.withColumn("_c", F.coalesce(fits, F.lit(False)))
    linked = F.col("_c") & F.coalesce(F.lag("_c").over(order), F.lit(False)) & (F.col("n_items") == 1)
    p = p.withColumn("_island", F.sum(F.when(linked, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    p = p.withColumn("_k", F.row_number().over(W.partitionBy("doc_id", "_island").orderBy("page_number")))
    same = F.coalesce(F.col("last_header") == F.col("_next.first_header"), F.lit(False))
    out = p.where("_c and _k % 2 = 1")
    return out.select("doc_id", "page_number", F.col("_next.page_number").alias("from_page"), same.alias("header_dropped"), (F.col("last_rows") + F.col("_next.first_rows") - F.when(same, 1).otherwise(0)).alias("n_rows"))
