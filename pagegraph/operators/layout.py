"""Page layout: masking, gutters, lines, slices, columns, blocks, reading order.

Glyphs should come dealt by page (the mask's join does it where they don't); all that follows is keyed by the page and
finer keys and exchanges none of them again. They are sorted twice, as they follow each other on the page and within
its slices, and every window reads one of these two orders. What holds for a page, its gutters and metrics, is summed
by passes of their own and joined by hash, which keeps the orders. Text items come from ``pages``, which has the same
rules over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, PAGE, Layout
from ..functions.text import strip_ws
from .glyphs import normalised, page_metrics, safe_zone, with_angle
from .pages import page_blocks

BUCKET = [*PAGE, "angle"]
WITHIN = ["ntop", "nx0", "seq"]
WHOLE, SO_FAR, BEFORE = (W.unboundedPreceding, W.unboundedFollowing), (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)


def mask(glyphs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Glyphs that no box of their page covers (its right edge is not asked for)."""
    b = boxes.select(*(F.col(c).alias(f"_{c}") for c in (*PAGE, "x0", "top", "x1", "bottom")))
    inside = (F.col("x0") >= F.col("_x0")) & (F.col("x0") <= F.col("_x1")) & (F.col("top") >= F.col("_top")) & (F.col("bottom") <= F.col("_bottom"))
    return glyphs.join(b.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_number") == F.col("_page_number")) & inside, "left_anti")


def coverage(glyphs: DataFrame) -> DataFrame:
    """Histogram of covered x bins per page: one row per bin from 0 to the page's width less one.

    Glyphs add +1 where they begin and -1 behind their end; the running sum over these few marks per bin is the
    coverage, so the work is glyphs plus bins, not glyphs times width.
    """
    lo = F.greatest(F.lit(0), F.col("x0").cast("int"))
    hi = F.least(F.col("page_width").cast("int"), F.col("x1").cast("int") + 1)
    g = glyphs.select(*PAGE, F.col("page_width").cast("int").alias("w"), lo.alias("lo"), hi.alias("hi"), (F.col("x1") - F.col("x0")).alias("gw"))
    marks = g.select(*PAGE, F.inline(F.array(F.struct(F.col("lo").alias("x"), F.when(F.col("hi") > F.col("lo"), 1).otherwise(0).alias("d")), F.struct(F.col("hi").alias("x"), F.when(F.col("hi") > F.col("lo"), -1).otherwise(0).alias("d")))))
    bins = g.groupBy(*PAGE).agg(F.max("w").alias("w")).where("w > 0").select(*PAGE, F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), F.lit(0).alias("d"))
    steps = marks.unionByName(bins).groupBy(*PAGE, "x").agg(F.sum("d").alias("d"))
    total = steps.withColumn("n", F.sum("d").over(W.partitionBy(*PAGE).orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    widths = g.groupBy(*PAGE).agg(F.max("w").alias("w"), F.avg("gw").alias("avg_width"))
    return total.join(widths, PAGE).where("x < w").select(*PAGE, "x", "n", "w", "avg_width")


def smoothed(histogram: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Box blur; windows at the edges are shorter."""
    return histogram.withColumn("smooth", F.avg("n").over(W.partitionBy(*PAGE).orderBy("x").rowsBetween(-cfg.blur, cfg.blur)))


def gutters(smooth: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Empty stretches that a covered bin closes and that are wide enough: g0, g1 (exclusive)."""
    order = W.partitionBy(*PAGE).orderBy("x")
    gap = F.col("smooth") < 0.1
    runs = smooth.withColumn("gap", gap).withColumn("island", F.sum(F.when(gap, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.where("gap").groupBy(*PAGE, "island").agg(F.min("x").alias("g0"), (F.max("x") + 1).alias("g1"), F.first("w").alias("w"), F.first("avg_width").alias("aw"))
    return runs.where((F.col("g1") < F.col("w")) & (F.col("g1") - F.col("g0") > cfg.gutter_width * F.col("aw"))).select(*PAGE, "g0", "g1")


def page_gutters(glyphs: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """The gutters of ``gutters(smoothed(coverage(glyphs)))`` without the histogram.

    Counts are whole, so a mean of fewer than ten bins is below 0.1 only where all of them are empty: the empty
    stretches are what no glyph covers, with ``blur`` bins added at both its ends. A page's covered stretches, the
    furthest end per begin, are few, and a fold in order joins them.
    """
    if cfg.blur > 4:
        return gutters(smoothed(coverage(glyphs), cfg), cfg)
    w = F.col("page_width").cast("int")
    lo, hi = F.greatest(F.lit(0), F.col("x0").cast("int")), F.least(w, F.col("x1").cast("int") + 1)
    begins = glyphs.groupBy(*PAGE, lo.alias("lo")).agg(F.max(hi).alias("hi"), F.max(w).alias("w"), F.sum(F.col("x1") - F.col("x0")).alias("s"), F.count("*").alias("c"))
    pages = begins.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.when(F.col("hi") > F.col("lo"), F.struct("lo", "hi")))).alias("covered"), F.max("w").alias("w"), (F.sum("s") / F.sum("c")).alias("aw"))
    fold = f"""aggregate(covered, named_struct('upto', 0, 'out', cast(array() as array<struct<g0:int,g1:int>>)),
      (a, x) -> named_struct('upto', greatest(a.upto, x.hi + {cfg.blur}), 'out', if(x.lo - {cfg.blur} > a.upto, array_append(a.out, named_struct('g0', a.upto, 'g1', x.lo - {cfg.blur})), a.out)), a -> a.out)"""
    found = pages.select(*PAGE, "w", "aw", F.inline(F.expr(fold)))
    return found.where((F.col("g1") < F.col("w")) & (F.col("g1") - F.col("g0") > cfg.gutter_width * F.col("aw"))).select(*PAGE, "g0", "g1")


def lines(glyphs: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """``line`` by chained vertical distance in normalised space. As in the SQL, what belongs to no document or page is in no line."""
    order = W.partitionBy(*BUCKET).orderBy(*WITHIN)
    placed = glyphs.where(F.col("doc_id").isNotNull() & F.col("page_number").isNotNull())
    g = placed.withColumns({"_last": F.lag("ntop").over(order), "avg_height": F.avg(F.abs(F.col("bottom") - F.col("top"))).over(order.rowsBetween(*WHOLE))})
    g = g.withColumn("_new", F.when(F.col("_last").isNull() | (F.abs(F.col("ntop") - F.col("_last")) >= cfg.line_glue * F.col("avg_height")), 1).otherwise(0))
    return g.withColumn("line", F.sum("_new").over(order.rowsBetween(*SO_FAR))).drop("_last")


def slices(lined: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """``slice``: lines with a gap before them open one. Lines are numbered in the glyphs' order, so the greatest line and bottom so far are those of the line before."""
    order = W.partitionBy(*BUCKET).orderBy(*WITHIN)
    g = lined.withColumn("_before", F.max(F.struct("line", "nbottom")).over(order.rowsBetween(*BEFORE)))
    end = F.col("_before.nbottom")
    g = g.withColumn("_cut", F.when((F.col("_new") == 1) & (end.isNull() | (F.col("ntop") - end >= cfg.slice_gap * F.col("avg_height"))), 1).otherwise(0))
    return g.withColumn("slice", F.sum("_cut").over(order.rowsBetween(*SO_FAR))).drop("_before", "_cut", "_new")


def columns(sliced: DataFrame, found: DataFrame) -> DataFrame:
    """``column_id`` by the gutter that holds the slice's middle; glyphs across it vanish. A page's gutters never overlap, so it is one at most."""
    part = W.partitionBy(*BUCKET, "slice").orderBy(*WITHIN).rowsBetween(*WHOLE)
    g = sliced.withColumns({"_min": F.min("nx0").over(part), "_max": F.max("nx1").over(part)})
    per_page = found.select(*(F.col(c).alias(f"_{c}") for c in (*PAGE, "g0", "g1"))).hint("shuffle_hash")
    g0, g1, middle = F.col("_g0"), F.col("_g1"), F.col("_min") + (F.col("_max") - F.col("_min")) / 2
    holds = (F.col("_min") < g0) & (g1 < F.col("_max")) & (g0 < middle) & (middle < g1)
    g = g.join(per_page, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_number") == F.col("_page_number")) & holds, "left")
    col = F.when(g0.isNull(), 0).when(F.col("nx1") <= g0, 1).when(F.col("nx0") >= g1, 2)
    return g.withColumn("column_id", col).where("column_id is not null").drop("_min", "_max", "_doc_id", "_page_number", "_g0", "_g1")


def spaced(glyphs: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """``block`` numbers within (slice, column), and ``piece``: the glyph with a space before it where the gap asks for one.

    A slice has one column or two, read in the slice's order: each glyph looks back to the last one of its own column.
    """
    order = W.partitionBy(*BUCKET, "slice").orderBy(*WITHIN)
    right = F.col("column_id") == 2

    def own(of) -> Column:
        return F.when(right, of(right)).otherwise(of(~right))

    state = F.struct("ntop", "nbottom", "size", "nx1")
    g = glyphs.withColumns({"_prev": own(lambda side: F.last(F.when(side, state), ignorenulls=True).over(order.rowsBetween(*BEFORE))), "rank": F.row_number().over(order)})
    prev, first = F.col("_prev"), F.col("_prev").isNull()
    cut = first | (F.col("ntop") - prev["nbottom"] > cfg.block_gap * prev["size"]) | (F.abs(F.col("size") - prev["size"]) > cfg.block_size)
    gap = ~first & (F.abs(F.col("ntop") - prev["ntop"]) < cfg.space_line * F.col("size")) & (F.col("nx0") - prev["nx1"] > cfg.space_gap * F.col("size"))
    g = g.withColumns({"_cut": F.when(cut, 1).otherwise(0), "_gap": gap})
    g = g.withColumn("block", own(lambda side: F.sum(F.when(side, F.col("_cut")).otherwise(0)).over(order.rowsBetween(*SO_FAR))))
    return g.withColumn("piece", F.when(F.col("_gap") & (F.col("_cut") == 0), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))).drop("_cut", "_gap", "_prev")


def blocks(pieces: DataFrame, metrics: DataFrame) -> DataFrame:
    """Text blocks with type, mean size and boxes in both spaces; ``metrics``: of the kept glyphs, by page and angle."""
    text = F.array_join(F.sort_array(F.collect_list(F.struct("rank", "piece")))["piece"], "")
    out = pieces.groupBy(*BUCKET, "slice", "column_id", "block").agg(
        text.alias("text"), F.avg("size").alias("font_size"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.min("ntop").alias("ntop"), F.max("nbottom").alias("nbottom"),
    )
    per_page = metrics.groupBy(*PAGE).agg(F.collect_list(F.struct("angle", "heading_threshold", "first_seq")).alias("_m"))  # by page, as the blocks are dealt
    out = out.join(per_page.hint("shuffle_hash"), PAGE).withColumn("_m", F.try_element_at(F.filter("_m", lambda m: m["angle"] == F.col("angle")), F.lit(1)))
    return out.withColumns({"text": strip_ws(F.col("text")), "first_seq": F.col("_m.first_seq"), "type": F.when(F.col("font_size") >= F.col("_m.heading_threshold"), "heading").otherwise("paragraph")}).drop("_m")


def merged(found: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """Adjacent blocks of a column that belong together; the run's head keeps its size, its top and its type.

    The gap is measured against the head's size but the last block's end, which no window frame can express: a
    fold over the column's few blocks does.
    """
    fields = ["block", "text", "type", "font_size", "x0", "top", "x1", "bottom", "ntop", "nbottom", "head_top"]
    arr = found.withColumn("head_top", F.col("top")).groupBy(*BUCKET, "slice", "column_id", "first_seq").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("bs"))
    kind = arr.schema["bs"].dataType.simpleString()
    glue = "if(endswith(a.cur.text, '-'), concat(substring(a.cur.text, 1, length(a.cur.text) - 1), x.text), concat(a.cur.text, ' ', x.text))"
    fold = f"""aggregate(slice(bs, 2, size(bs)), named_struct('out', cast(array() as {kind}), 'cur', bs[0]),
      (a, x) -> if(a.cur.type = x.type and abs(x.ntop - a.cur.nbottom) < a.cur.font_size * {cfg.merge_gap},
        named_struct('out', a.out, 'cur', named_struct('block', a.cur.block, 'text', {glue}, 'type', a.cur.type, 'font_size', a.cur.font_size,
          'x0', least(a.cur.x0, x.x0), 'top', least(a.cur.top, x.top), 'x1', greatest(a.cur.x1, x.x1), 'bottom', greatest(a.cur.bottom, x.bottom),
          'ntop', a.cur.ntop, 'nbottom', x.nbottom, 'head_top', a.cur.head_top)),
        named_struct('out', array_append(a.out, a.cur), 'cur', x)),
      a -> array_append(a.out, a.cur))"""
    return arr.select(*BUCKET, "slice", "column_id", "first_seq", F.inline(F.expr(fold)))


def object_column(objects: DataFrame, cfg: Layout = DEFAULT) -> DataFrame:
    """``column_id`` of tables and images: 0 if wide or if the page has no text (``has_text``)."""
    side = F.when(F.col("x0") < F.col("page_width") / 2, 1).otherwise(2)
    return objects.withColumn("column_id", F.when(F.col("has_text") & (F.col("x1") - F.col("x0") < cfg.narrow * F.col("page_width")), side).otherwise(0))


def reading_order(items: DataFrame) -> DataFrame:
    """``ord`` from 1 per page: columns first, spanning items last, then by top; ties by arrival."""
    order = W.partitionBy(*PAGE).orderBy(F.when(F.col("column_id") == 0, 999).otherwise(F.col("column_id")), "top", "arrival")
    return items.withColumn("ord", F.row_number().over(order))


def text_items(glyphs: DataFrame, boxes: DataFrame, cfg: Layout = DEFAULT, by_page: bool = False) -> DataFrame:
    """Text items of pages outside ``boxes``, with ``at`` (where reading order puts them) and ``arrival``."""
    if cfg.blur > 4:  # gutters need the histogram
        safe = with_angle(safe_zone(glyphs, cfg))
        kept = normalised(mask(safe, boxes))
        laid = columns(slices(lines(kept, cfg), cfg), page_gutters(safe, cfg))
        out = merged(blocks(spaced(laid, cfg), page_metrics(kept, cfg)), cfg)
    else:
        out = page_blocks(glyphs, boxes, cfg, by_page=by_page)
    arrival = F.struct("first_seq", F.col("slice").cast("long").alias("slice"), F.col("column_id").alias("column"), F.col("block").cast("long").alias("block"))
    return out.select(*PAGE, F.col("head_top").alias("at"), arrival.alias("arrival"), "type", "text", "column_id", "font_size", "x0", "top", "x1", "bottom", F.col("angle").alias("rotation"))


def object_items(objects: DataFrame, text: DataFrame, kind: str, cfg: Layout = DEFAULT) -> DataFrame:
    """Tables or images (page_width, seq and what they hold) as items after the page's text at equal tops."""
    seen = text.select(*PAGE).distinct().withColumn("has_text", F.lit(True))
    o = object_column(objects.join(seen, PAGE, "left").withColumn("has_text", F.coalesce("has_text", F.lit(False))), cfg)
    arrival = F.struct(F.lit(2**62 + (kind == "image")).alias("first_seq"), F.col("seq").cast("long").alias("slice"), F.lit(0).alias("column"), F.lit(0).cast("long").alias("block"))
    return o.select(*PAGE, F.col("top").alias("at"), arrival.alias("arrival"), F.lit(kind).alias("type"), "column_id", "x0", "top", "x1", "bottom", *(c for c in ("data", "metadata", "base64_data") if c in objects.columns))


def ordered(items: DataFrame) -> DataFrame:
    """Items with ``ord`` in place of ``at`` and ``arrival``."""
    out = reading_order(items.withColumn("_top", F.col("top")).withColumn("top", F.col("at")))
    return out.withColumn("top", F.col("_top")).drop("_top", "at", "arrival")


def parse(glyphs: DataFrame, boxes: DataFrame, cfg: Layout = DEFAULT, by_page: bool = False) -> DataFrame:
    """Glyphs of pages to text items in reading order; ``by_page``: a page's glyphs follow each other."""
    items = ordered(text_items(glyphs, boxes, cfg)) if cfg.blur > 4 else page_blocks(glyphs, boxes, cfg, by_page=by_page).withColumn("rotation", F.col("angle"))
    return items.select(*PAGE, "ord", "type", "text", "column_id", "font_size", "x0", "top", "x1", "bottom", "rotation")
