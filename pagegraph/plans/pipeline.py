"""The whole document run as DataFrames: parse, tidy, link, weave, audit. Nothing here acts; sinks do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PAGE, Layout
from ..operators import document as D
from ..operators import graph as R
from ..operators import layout as L


def parse(glyphs: DataFrame, boxes: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Text items of all pages in reading order."""
    return L.parse(glyphs, boxes, cfg)


def tidy(items: DataFrame, pages: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Without running headers and footers."""
    return D.strip_exclusion(items, D.exclusion_zones(items, pages, cfg))


def link(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Items with ``semantic_context`` (text above, text below) where an image has text near it."""
    context = D.semantic_link(items, cfg).select(*PAGE, F.col("image_ord").alias("ord"), F.struct("text_above", "text_below").alias("semantic_context"))
    return items.join(context, [*PAGE, "ord"], "left")


def typed(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    return D.promote(items, D.doc_heading_threshold(items, cfg)) if "node_type" not in items.columns else items


def anchors(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """visual_evidence and keyword_anchor edges of items with node types."""
    kinds = items.select(*PAGE, "ord", "node_type")
    near = R.spatial_anchor(items, cfg).select(*PAGE, "node_ord", F.col("page_number").alias("text_page"), "text_ord", F.lit("visual_evidence").alias("r"))
    named = R.keyword_anchor(items).select(*PAGE, "node_ord", "text_page", "text_ord", F.lit("keyword_anchor").alias("r"))
    both = near.unionByName(named).join(kinds.withColumnRenamed("ord", "node_ord"), [*PAGE, "node_ord"])
    f = R.node_id(F.col("node_type"), F.col("doc_id"), F.col("page_number"), F.col("node_ord"))
    t = R.node_id(F.lit("paragraph"), F.col("doc_id"), F.col("text_page"), F.col("text_ord"))
    return both.select("doc_id", "page_number", F.col("node_ord").alias("ord"), f.alias("f"), t.alias("t"), "r")


def weave(items: DataFrame, pages: DataFrame, cfg: Layout = DEFAULT, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges. With ``compat`` tables and images carry no box, as after the original's clean-up, and so no anchors."""
    t = typed(items, cfg)
    if compat:
        boxed = F.col("type").isin("heading", "paragraph")
        t = t.withColumns({c: F.when(boxed, F.col(c)) for c in ("x0", "top", "x1", "bottom")})
    nodes, edges = R.weave_nodes(t, pages, cfg), R.weave_edges(t, pages, cfg)
    return nodes, edges if compat else edges.unionByName(anchors(t, cfg))


def audit(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tree lines, orphans, and edges whose target is missing."""
    return R.tree_lines(nodes, edges), R.orphans(nodes, edges), R.dangling(nodes, edges)
