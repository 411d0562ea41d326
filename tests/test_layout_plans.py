"""What glyph queries exchange and sort, and odd documents against the SQL."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagegraph.config import PAGE
from pagegraph.operators import glyphs as G
from pagegraph.operators import layout as L
from pagegraph.operators import pages as PG
from pagegraph.plans import fixtures as FX
from pagegraph.plans import registry

from .test_oracles import SF, rows

QUERIES = ["column_assign", "space_recovery", "text_blocks", "merge_blocks", "reading_order"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents without text or id, of a page's exact length, of characters beyond 16 bits, of many pages."""
    d = tmp_path_factory.mktemp("odd")
    texts = [None, "", " \n ", "a" * 1600, "b " * 800 + "c", "\U0001f600é\nx " * 700, "word another\n" * 900, "long " * 400]
    ids = [10, 11, 12, 20, 21, 30, 31, None]
    pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts}).to_parquet(f"{d}/documents.parquet")
    return str(d)


def above(plan: str) -> list[list[str]]:
    """For each step that makes glyphs of texts: the steps between it and the plan's top."""
    stack, out = [], []
    for line in plan.split("\n"):
        if m := re.match(r"([ :]*(?:\+- |:- )?)(?:\*\(\d+\) )?(\w.*)", line):
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, m[2])]
            if m[2].startswith("Generate posexplode(split("):
                out.append([x for _, x in stack[:-1]])
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_glyphs_are_not_exchanged_and_sorted_twice_at_most(spark, name):
    found = above(registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert found
    for steps in found:
        assert not [x for x in steps if x.startswith("Exchange")]
        assert sum(x.startswith("Sort ") and "ntop" in x for x in steps) <= 2
        assert not [x for x in steps if x.startswith("SortMergeJoin")]


@pytest.mark.parametrize("name", QUERIES)
def test_odd_documents(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet'")
    for t in "region nation customer supplier part orders lineitem events pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, odd).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["merge_blocks", "reading_order"])
def test_glyphs_are_neither_sorted_nor_kept(spark, name):
    """What buffers a task's glyphs goes to disk where they don't fit its memory."""
    found = above(registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(found) == 1
    assert not [x for x in found[0] if re.match(r"Sort|Window|\w*Aggregate|Exchange", x)]


FIELDS = ["angle", "slice", "column_id", "block", "first_seq", "text", "type", "font_size", "x0", "top", "x1", "bottom", "ntop", "nbottom"]


def odd_glyphs(spark):
    """Pages of two columns or one, of several sizes and angles; texts of no, one or many characters; glyphs in one place; a page that boxes cover; ids that are null."""
    rng = random.Random(5)
    out, boxes = [], [("p3", 1, 0.0, 0.0, 700.0, 800.0), ("p1", 2, 100.0, 100.0, 330.0, 300.0), ("p1", 2, 90.0, 90.0, 200.0, 200.0)]
    for doc, page in [("p1", 1), ("p1", 2), ("p2", 1), ("p3", 1), ("ä", 7), (None, 1), ("p4", None), *((f"q{k}", 1) for k in range(12))]:
        split, angles = rng.random() < 0.6, rng.choice([[0.0], [0.0, 90.0], [0.0, 90.0, 33.3]])
        for seq in range(rng.choice([1, 40, 300, 900])):
            x, y = rng.choice([50, 330]) + 6.0 * rng.randrange(35 if split else 90), 60 + 14.5 * rng.randrange(46) + rng.choice([0, 0, 0.4])
            size, turn = rng.choice([10.0, 10.0, 10.25, 8.15, 16.0]), rng.choice(angles)
            matrix = {0.0: rng.choice([None, [], [1.0, 0.0], [2.0, 0.0, 0.0, 1.0]]), 90.0: [0.0, 1.0], 33.3: [0.8358, 0.549]}[turn]
            out.append((doc, page, seq * 3 if rng.random() < 0.9 else 1, rng.choice(["a", "b", "-", " ", "é", "fi\u2003", "", "\U0001f600", "\x1f", "\u3000", None]), size, x, y, x + rng.choice([4.5, 5.5]), y + size, 4.5, matrix, 612.0, 792.0))
    rng.shuffle(out)
    g = spark.createDataFrame(out, "doc_id string, page_number int, seq long, text string, size double, x0 double, top double, x1 double, bottom double, width double, matrix array<double>, page_width double, page_height double")
    return g.dropDuplicates(["doc_id", "page_number", "seq", "x0", "top"]), spark.createDataFrame(boxes, "doc_id string, page_number int, x0 double, top double, x1 double, bottom double")


@pytest.mark.parametrize("batch", [7, 10_000])
def test_pages_over_arrays_follow_the_rules_of_rows(spark, monkeypatch, batch):
    g, boxes = odd_glyphs(spark)
    g = g.cache()
    safe = G.with_angle(G.safe_zone(g))
    kept = L.normalised(L.mask(safe, boxes))
    found = L.blocks(L.spaced(L.columns(L.slices(L.lines(kept)), L.page_gutters(safe))), G.page_metrics(kept))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for merge, want in ((False, found), (True, L.merged(found))):
            got = PG.page_blocks(g, boxes, merge=merge).toPandas()
            assert rows(got[[*PAGE, *FIELDS]]) == rows(want.select(*PAGE, *FIELDS).toPandas()) and len(got) > 100
        items = L.text_items(g, boxes)
        assert rows(L.parse(g, boxes).toPandas()) == rows(L.ordered(items).select(*L.parse(g, boxes).columns).toPandas())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_are_handed_on_whole(spark):
    import pyarrow as pa

    pages = [k for k, n in enumerate([3, 1, 70_000, 5, 66_000, 66_000, 2]) for _ in range(n)]
    t = pa.table({"doc_id": pa.array(["d"] * len(pages)), "page_number": pa.array(pages, pa.int32())})
    for size in (1000, 65_536, 70_004, 1_000_000):
        out = [x.column("page_number").to_pylist() for x in PG._whole_pages(iter(t.to_batches(max_chunksize=size)))]
        assert [x for p in out for x in p] == pages and not [1 for a, b in zip(out, out[1:], strict=False) if a[-1] == b[0]]


def test_texts_of_one_page_are_laid_out_together(spark, tmp_path):
    """Rows that share a doc_id hold glyphs of the same pages."""
    pd.DataFrame({"doc_id": [1, 2, 1, 3, 1], "text": ["one two", "x", "three " * 300, "y", None]}).to_parquet(tmp_path / "documents.parquet")
    want = L.merged(registry._blocks(spark, str(tmp_path))).groupBy(*PAGE).agg(F.count("*").alias("n"))
    got = PG.page_blocks(FX.glyphs(spark, str(tmp_path)), FX.layout_boxes(spark, str(tmp_path)), by_page=True).groupBy(*PAGE).agg(F.count("*").alias("n"))
    assert rows(got.toPandas()) == rows(want.toPandas())
