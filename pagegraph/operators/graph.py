"""The document graph: hierarchy, nodes, edges, anchors, traversal, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, PAGE, Layout
from ..functions.text import compress, heal_hyphens, metadata_ordinal, strip_ws
from ..sources.scratch import cut

#: Edges that make the tree.
STRUCTURE = ("contains", "body_text", "sub_content")


def heading_parent(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Headings with ``parent_ord`` (null: the page): the nearest open heading that is larger by more than the tolerance.

    The tolerance is not transitive, so the stack of open headings is folded over the page's few headings.
    """
    heads = items.where("node_type = 'heading'").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("font_size", F.lit(0.0)).alias("f")))).alias("hs"))
    frame = "array<struct<ord:int,f:double>>"
    keep = f"coalesce(array_max(transform(a.st, (s, k) -> if(x.f < s.f - {cfg.stack_tolerance}, k + 1, 0))), 0)"
    fold = f"""aggregate(hs, named_struct('st', cast(array() as {frame}), 'res', cast(array() as array<struct<ord:int,parent_ord:int>>)),
      (a, x) -> named_struct('st', array_append(slice(a.st, 1, {keep}), x),
        'res', array_append(a.res, named_struct('ord', x.ord, 'parent_ord', try_element_at(a.st, nullif({keep}, 0)).ord))),
      a -> a.res)"""
    return heads.select(*PAGE, F.inline(F.expr(fold)))


def body_parent(items: DataFrame) -> DataFrame:
    """Other items with the heading that they follow on their page (null: the page)."""
    w = W.partitionBy(*PAGE).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn("parent_ord", F.last(F.when(F.col("node_type") == "heading", F.col("ord")), ignorenulls=True).over(w)).where("node_type <> 'heading'").select(*PAGE, "ord", "parent_ord")


def node_id(kind, *parts):
    """A stable id: kind and 16 hex digits of what the node is."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(F.concat_ws("/", *(p.cast("string") for p in parts)), 256), 1, 16))


def _ids():
    doc, page = F.col("doc_id"), F.col("page_number")
    return node_id(F.lit("root"), doc), node_id(F.lit("page"), doc, page), lambda kind, o: node_id(kind, doc, page, o)


def weave_nodes(items: DataFrame, pages: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """node_id, t, c, ord, num, col, font_size, b0..b3 (whole numbers) of all nodes; root, pages, items."""
    root, page, item = _ids()
    none = F.lit(None)
    text = F.coalesce(F.col("text"), F.lit(""))
    healed = F.when(F.col("node_type") == "paragraph", heal_hyphens(text)).otherwise(text)
    c = F.when(text == "", F.concat(F.lit("["), F.col("type"), F.lit("]"))).when(healed != text, healed).otherwise(text.substr(1, cfg.node_text))
    body = items.select("doc_id", item(F.col("node_type"), F.col("ord")).alias("node_id"), F.col("node_type").alias("t"), c.alias("c"), "page_number", "ord", none.cast("int").alias("num"), "font_size", *(compress(F.col(x)).alias(f"b{i}") for i, x in enumerate(("x0", "top", "x1", "bottom"))))
    p = pages.select("doc_id", page.alias("node_id"), F.lit("page").alias("t"), F.concat(F.lit("Page "), F.col("page_number")).alias("c"), "page_number", F.lit(0).alias("ord"), F.col("page_number").cast("int").alias("num"))
    r = pages.select("doc_id").distinct().select("doc_id", root.alias("node_id"), F.lit("root").alias("t"), F.lit("Document").alias("c"), F.lit(0).alias("page_number"), F.lit(0).alias("ord"))
    return body.unionByName(p, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)


def weave_edges(items: DataFrame, pages: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """doc_id, f, t, r: root contains pages, pages and headings contain headings, and carry body text."""
    root, page, item = _ids()
    heads = heading_parent(items, cfg).withColumn("r", F.lit("contains"))
    body = body_parent(items).withColumn("r", F.lit("body_text"))
    kinds = items.select(*PAGE, "ord", "node_type")
    own = heads.unionByName(body).join(kinds, [*PAGE, "ord"])
    source = F.when(F.col("parent_ord").isNull(), page).otherwise(item(F.lit("heading"), F.col("parent_ord")))
    out = own.select("doc_id", "page_number", "ord", source.alias("f"), item(F.col("node_type"), F.col("ord")).alias("t"), "r")
    return out.unionByName(pages.select("doc_id", "page_number", F.lit(0).alias("ord"), root.alias("f"), page.alias("t"), F.lit("contains").alias("r")))


def spatial_anchor(items: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """visual_evidence pairs: tables and images with earlier paragraphs of their page that stand close above or below."""
    box = ("x0", "top", "x1", "bottom")
    n = items.where(F.col("node_type").isin("table", "image") & F.col("x0").isNotNull()).select(*PAGE, F.col("ord").alias("node_ord"), *(compress(F.col(c)).alias(f"n_{c}") for c in box))
    p = items.where("node_type = 'paragraph' and x0 is not null").select(*PAGE, F.col("ord").alias("text_ord"), *(compress(F.col(c)).alias(c) for c in box))
    m = cfg.anchor_margin
    near = (F.col("top") - F.col("n_bottom")).between(0, m) | (F.col("n_top") - F.col("bottom")).between(0, m)
    return n.join(p, PAGE).where((F.col("text_ord") < F.col("node_ord")) & near & (F.col("x0") < F.col("n_x1")) & (F.col("x1") > F.col("n_x0"))).select(*PAGE, "node_ord", "text_ord")


def keyword_anchor(items: DataFrame) -> DataFrame:
    """keyword_anchor pairs: images and tables with earlier paragraphs of the document that name their number."""
    label = F.when(F.col("node_type") == "image", "Fig").otherwise("Table")
    n = items.where(F.col("node_type").isin("table", "image")).select("doc_id", "page_number", F.col("ord").alias("node_ord"), label.alias("label"), metadata_ordinal(F.col("metadata")).alias("num")).where("num is not null")
    low = F.lower("text")
    p = items.where("node_type = 'paragraph'").where(F.contains(low, F.lit("fig")) | F.contains(low, F.lit("table"))).select("doc_id", F.col("page_number").alias("text_page"), F.col("ord").alias("text_ord"), "text")
    earlier = F.struct("text_page", "text_ord") < F.struct(F.col("page_number").alias("text_page"), F.col("node_ord").alias("text_ord"))
    return n.join(p, "doc_id").where(earlier & F.expr("regexp_like(text, concat('(?i)', label, '.*?', num))")).select("doc_id", "page_number", "node_ord", "text_page", "text_ord")


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' types."""
    f = nodes.select("doc_id", F.col("node_id").alias("f"), F.col("t").alias("f_type"))
    t = nodes.select("doc_id", F.col("node_id").alias("t"), F.col("t").alias("t_type"))
    return edges.select("doc_id", "f", "t", "r").join(f, ["doc_id", "f"]).join(t, ["doc_id", "t"])


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("doc_id", "t").agg(F.count("*").alias("n_in"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes but roots that no edge leads to, with the audit's line."""
    to = edges.select("doc_id", F.col("t").alias("node_id"))
    out = nodes.where("t <> 'root'").join(to, ["doc_id", "node_id"], "left_anti")
    return out.select("doc_id", "node_id", "t", F.concat(F.substring("c", 1, 100), F.lit("...")).alias("line"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select("doc_id", F.col("node_id").alias("t")), ["doc_id", "t"], "left_anti")


def tree_paths(nodes: DataFrame, edges: DataFrame, place: Column) -> DataFrame:
    """Nodes that structural edges reach from the roots: doc_id, node_id, t, c, path, level; sorting by path gives pre-order.

    One join per level until a level is empty, each level a scratch table, so plans stay small at any depth. A path
    collects ``place`` of its nodes (of the columns top, e_page, e_ord). It ends at a node that it holds already,
    and a node that several paths reach has the first of them, so cycles and shared parts come once for every root.
    """
    kids = edges.where(F.col("r").isin(*STRUCTURE)).select("doc_id", F.col("f").alias("parent"), F.col("t").alias("node_id"), F.col("page_number").alias("e_page"), F.col("ord").alias("e_ord"))
    n = cut(nodes.select("doc_id", "node_id", "t", "c", F.coalesce("b1", F.lit(0)).alias("top")))
    child = cut(kids.join(n, ["doc_id", "node_id"]).select("doc_id", "parent", "node_id", "t", "c", place.alias("place")))
    kind = child.schema["place"].dataType.simpleString()
    level = n.where("t = 'root'").select("doc_id", "node_id", "t", "c", F.expr(f"cast(array() as array<{kind}>)").alias("path"), F.lit(0).alias("level"), F.col("node_id").alias("root"), F.array("node_id").alias("ids"))
    levels = [level]
    while True:
        up = levels[-1].select("doc_id", "root", F.col("node_id").alias("parent"), F.col("path").alias("p"), F.col("ids").alias("above"))
        step = child.join(up, ["doc_id", "parent"]).where(~F.array_contains("above", F.col("node_id")))
        step = step.groupBy("doc_id", "root", "node_id").agg(F.min(F.struct(F.array_append("p", F.col("place")).alias("path"), "t", "c", F.array_append("above", F.col("node_id")).alias("ids"))).alias("s"))
        level = cut(step.select("doc_id", "node_id", "s.t", "s.c", "s.path", F.lit(len(levels)).alias("level"), "root", "s.ids"))
        if level.isEmpty():
            break
        levels.append(level)
    every = reduce(DataFrame.unionByName, levels)
    first = every.groupBy("doc_id", "root", "node_id").agg(F.min(F.struct("path", "t", "c", "level")).alias("s"))
    return first.select("doc_id", "node_id", "root", "s.*")


def tree_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pre-order lines of every document's tree, however deep: doc_id, pos (from 1), level, line.

    Children come by their box's top, then in edge order.
    """
    every = tree_paths(nodes, edges, F.struct("top", F.col("e_page").alias("page"), F.col("e_ord").alias("ord")))
    clean = strip_ws(F.replace(F.col("c"), F.lit("\n"), F.lit(" ")))
    text = F.when(F.length(clean) > 80, F.concat(clean.substr(1, 80), F.lit("..."))).otherwise(clean)
    marker = F.when(F.col("t").isin("root", "page", "heading"), "[FOLDER]").otherwise("[FILE]")
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), marker, F.lit(" ["), F.upper("t"), F.lit("] "), text)
    return every.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("root", "path")).cast("long").alias("pos"), F.col("level").cast("long").alias("level"), line.alias("line"))


def escape(c):
    """Text safe inside HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def html_render(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One HTML text per document: pages in order, each page's nodes in reading order, escaped.

    The badge says how a node is anchored; of several anchors the last by kind wins.
    """
    anchors = edges.where(F.col("r").isin("visual_evidence", "keyword_anchor")).groupBy("doc_id", F.col("f").alias("node_id")).agg(F.min("r").alias("anchor"))
    n = nodes.where("t not in ('root')").join(anchors, ["doc_id", "node_id"], "left")
    badge = F.when(F.col("anchor") == "visual_evidence", '<div class="anchor-badge">Spatial Link</div>').when(F.col("anchor") == "keyword_anchor", '<div class="anchor-badge">Semantic Link</div>').otherwise("")
    page = F.concat(F.lit('<div class="page-header">Page '), F.col("num").cast("string"), F.lit("</div>"))
    node = F.concat(F.lit('<div class="node">'), badge, F.lit('<span class="node-tag tag-'), F.col("t"), F.lit('">'), F.col("t"), F.lit('</span><div class="content">'), escape(F.col("c")), F.lit("</div></div>"))
    parts = n.select("doc_id", F.struct("page_number", "ord", F.when(F.col("t") == "page", page).otherwise(node).alias("h")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]), "\n")
    return parts.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE html><html><body>"), body, F.lit("</body></html>")).alias("html"))
