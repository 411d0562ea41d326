"""Rules at their edges, and folds against plain models, on small inputs."""

import random

import pytest

from pagegraph.functions import text as X
from pagegraph.operators import boxes as B
from pagegraph.operators import document as D
from pagegraph.operators import glyphs as G
from pagegraph.operators import graph as R
from pagegraph.operators import layout as L
from pagegraph.operators import tables as TB
from pagegraph.plans import pipeline as PL
from pagegraph.sources import readers, sinks
from pagegraph.streaming.files import parse_arrivals

GLYPH = "doc_id long, page_number int, seq long, text string, size double, x0 double, x1 double, top double, bottom double, width double, matrix array<double>, page_width double, page_height double"


def glyph(seq, text, x0, top, size=10.0, page=1, width=4.5, matrix=(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)):
    return (1, page, seq, text, size, float(x0), x0 + width, float(top), top + size, width, list(matrix), 612.0, 792.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, GLYPH)


def boxes(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, page_number int, x0 double, top double, x1 double, bottom double")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a٣b4 \n", [0.0, 1.0], "x bbox=[1, 2.5, 3, 4] y_12")], "t string, m array<double>, md string")
    row = df.select(
        X.strip_ws(F.col("t")).alias("a"), X.without_digits(F.col("t")).alias("b"), X.rotation_angle(F.col("m")).alias("c"), X.metadata_ordinal(F.col("md")).alias("d"),
        *(c.alias(f"e{i}") for i, c in enumerate(X.bbox_from_metadata(F.col("md")))), X.heal_hyphens(F.lit("ex-\n ample")).alias("f"), X.rotation_angle(F.array(F.lit(1.0))).alias("g"), X.metadata_ordinal(F.lit("no")).alias("h"),
        X.join_blocks(F.lit("ab-"), F.lit("c")).alias("i"), X.join_blocks(F.lit("ab"), F.lit("c")).alias("j"), X.compress(F.lit(2.5)).alias("k"),
    ).first()
    assert tuple(row) == ("a٣b4", " ab \n", 90.0, "12", 1.0, 2.5, 3.0, 4.0, "example", 0.0, None, "abc", "ab c", 2)
    got = X.nfkc(spark.createDataFrame([("ﬁ",), ("a",), (None,)], "t string"), "t", "n").collect()
    assert {(r.t, r.n) for r in got} == {("ﬁ", "fi"), ("a", "a"), (None, None)}


def test_safe_zone_is_strict(spark):
    rows = [glyph(i, "a", 50, t) for i, t in enumerate((39.6, 39.61, 752.4, 752.39))]
    assert sorted(r.seq for r in G.safe_zone(frame(spark, rows)).collect()) == [1, 3]


def test_mode_tie_and_single_glyph(spark):
    rows = [glyph(0, "a", 50, 100, 12.0), glyph(1, "b", 60, 100, 10.0), glyph(2, "c", 70, 100, 10.0), glyph(3, "d", 80, 100, 12.0), glyph(9, "x", 50, 100, 9.0, page=2)]
    got = {r.page_number: r for r in G.page_metrics(G.with_angle(frame(spark, rows))).collect()}
    assert got[1].mode_size == 12.0 and got[2].sd_size == 0.0 and got[2].heading_threshold == pytest.approx(9 * 1.15)


def test_cid_pages(spark):
    rows = [glyph(i, t, 50, 100) for i, t in enumerate(["(cid:12)"] * 3 + ["ab"])] + [glyph(i, "a", 50, 100, page=2) for i in range(30)]
    assert {r.page_number: r.corrupt for r in G.cid_pages(frame(spark, rows)).collect()} == {1: True, 2: False}


def test_gutters_left_counts_right_does_not(spark):
    rows = [glyph(0, "a", 100, 100), glyph(1, "b", 300, 100)]
    got = sorted((r.g0, r.g1) for r in L.page_gutters(frame(spark, rows)).collect())
    assert got == [(0, 98), (107, 298)]
    assert L.coverage(frame(spark, [glyph(0, "a", 700, 100)])).agg({"n": "sum"}).first()[0] == 0


def test_columns_order_and_straddling(spark):
    rows, seq = [], 0
    for r in range(3):
        for x, word in ((50, "left"), (400, "right")):
            for i, c in enumerate(word):
                rows.append(glyph(seq, c, x + 5 * i, 100 + 14 * r))
                seq += 1
    rows.append(glyph(99, "Z", 200, 114, width=180))
    clean = L.parse(frame(spark, rows[:-1]), boxes(spark)).orderBy("ord").collect()
    assert [(r.column_id, r.text) for r in clean] == [(1, "leftleftleft"), (2, "rightrightright")]
    masked = L.parse(frame(spark, rows[:-1]), boxes(spark, [(1, 1, 395.0, 90.0, 500.0, 200.0)])).collect()
    assert [r.text for r in masked] == ["leftleftleft"] and masked[0].column_id == 0


def model_merge(blocks):
    out = []
    for b in blocks:
        b = dict(b, members=[b["k"]])
        if out and out[-1]["type"] == b["type"] and abs(b["ntop"] - out[-1]["nbottom"]) < 0.8 * out[-1]["font_size"]:
            out[-1]["members"] += b["members"]
            out[-1]["nbottom"] = b["nbottom"]
        else:
            out.append(b)
    return [tuple(x["members"]) for x in out]


def test_block_merge_model(spark):
    rng, rows, want = random.Random(1), [], {}
    for doc in range(40):
        own, y = [], 0.0
        for k in range(1, rng.randint(2, 9)):
            y += rng.choice([2.0, 8.0, 9.0, 11.0])
            own.append({"k": k, "type": rng.choice(["heading", "paragraph"]), "ntop": y, "nbottom": y + 5, "font_size": rng.choice([10.0, 12.0, 14.0])})
            y += 5
        want[doc] = model_merge(own)
        rows += [(doc, 1, 0.0, 1, 0, b["k"], f"t{b['k']}", b["font_size"], 0, 0.0, b["ntop"], 1.0, b["nbottom"], b["ntop"], b["nbottom"], b["type"]) for b in own]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, angle double, slice int, column_id int, block int, text string, font_size double, first_seq int, x0 double, top double, x1 double, bottom double, ntop double, nbottom double, type string")
    got: dict = {}
    for r in L.merged(df).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append(tuple(int(t[1:]) for t in r.text.split()))
    assert got == want


def test_heading_stack_model(spark):
    rng, rows, want = random.Random(2), [], {}
    pages = [[12.0, 11.6, 11.3]] + [[rng.choice([9.0, 9.4, 10.0, 10.5, 11.0, 12.0]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    for doc, sizes in enumerate(pages):
        stack: list = []
        for i, f in enumerate(sizes):
            while stack and f >= stack[-1][1] - 0.5:
                stack.pop()
            want[doc, i] = stack[-1][0] if stack else None
            stack.append((i, f))
            rows.append((doc, 1, i, f, "heading"))
    df = spark.createDataFrame(rows, "doc_id int, page_number int, ord int, font_size double, node_type string")
    assert {(r.doc_id, r.ord): r.parent_ord for r in R.heading_parent(df).collect()} == want
    assert [want[0, i] for i in range(3)] == [None] * 3


def test_heal_model(spark):
    rng, rows, want = random.Random(3), [], set()
    for doc in range(60):
        pages = []
        for p in range(1, rng.randint(2, 8)):
            items = [rng.choice(["text", ("table", rng.choice([2, 3]), rng.choice("ab"))]) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
            pages.append(items)
            first, last = items[0], items[-1]
            flags = [x != "text" for x in (first, last)]
            rows.append((doc, p, len(items), *flags, *(x[1] if x != "text" else 0 for x in (first, last)), *(x[2] if x != "text" else None for x in (first, last)), 2, 2))
        left = [list(x) for x in pages]
        for i in range(len(left) - 1):
            if left[i] and left[i + 1] and left[i][-1] != "text" and left[i + 1][0] != "text" and left[i][-1][1] == left[i + 1][0][1]:
                want.add((doc, i + 1))
                left[i + 1].pop(0)
    df = spark.createDataFrame(rows, "doc_id int, page_number int, n_items int, first_is_table boolean, last_is_table boolean, first_cols int, last_cols int, first_header string, last_header string, first_rows int, last_rows int")
    assert {(r.doc_id, r.page_number) for r in TB.heal(df).collect()} == want


def test_box_clusters(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, "a"), (1, 1, 1, 30.0, 0.0, 40.0, 10.0, "b"), (1, 1, 2, 15.0, 0.0, 25.0, 10.0, "c"), (1, 2, 0, 0.0, 0.0, 1.0, 1.0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, seq int, x0 double, top double, x1 double, bottom double, tag string")
    got = sorted((r.page_number, r.x0, r.x1, r.tag) for r in B.merge_boxes(df).collect())
    assert got == [(1, 0.0, 40.0, "a+c"), (2, 0.0, 1.0, "d")]


def test_table_validity(spark):
    cases = [([], False), ([["a"]], False), ([["a", ""], ["", ""]], False), ([["a", "b"]], True), ([["a", "b"]] * 6, False), ([["a", "b c"]] * 6, True), ([["k", "w " * 21]], False), ([["", ""], ["a", "b"], ["", ""]], True), ([["a", "b", "c", "d", "e"]] + [[""] * 5] * 4, True), ([["a", "b", "c", "d", ""]] + [[""] * 5] * 4, False)]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "doc_id int, data array<array<string>>")
    assert {r.doc_id: r.valid for r in TB.validity(df).collect()} == {i: v for i, (_, v) in enumerate(cases)}


ITEM = "doc_id long, page_number int, ord int, type string, text string, font_size double, x0 double, top double, x1 double, bottom double, metadata string, node_type string"


def item(ord_, kind, text=None, box=(0.0, 0.0, 10.0, 10.0), page=1, size=10.0, md=None):
    return (1, page, ord_, kind, text, size, *(box or (None,) * 4), md, kind)


def test_links_at_their_margins(spark):
    img = (100.0, 100.0, 200.0, 150.0)
    texts = {"up60": (100.0, 0.0, 200.0, 40.0), "up61": (100.0, 0.0, 200.0, 39.0), "in15": (100.0, 90.0, 200.0, 115.0), "down60": (100.0, 210.0, 200.0, 230.0), "down61": (100.0, 211.0, 200.0, 230.0), "side": (220.0, 60.0, 260.0, 90.0), "near": (219.0, 60.0, 260.0, 90.0)}
    rows = [item(0, "image", box=img), *(item(i + 1, "paragraph", n, b) for i, (n, b) in enumerate(texts.items())), item(50, "image", box=None), item(60, "paragraph", "none", None)]
    got = D.semantic_link(spark.createDataFrame(rows, ITEM)).collect()
    assert [(r.image_ord, r.text_above, r.text_below) for r in got] == [(0, "up60\nin15\nnear", "down60")]


def test_anchors(spark):
    rows = [item(0, "paragraph", "see FIGURE 13", (0.0, 0.0, 50.0, 40.0)), item(1, "image", box=(0.0, 100.0, 50.0, 150.0), md="p_3"), item(2, "paragraph", "Fig\n3", (0.0, 160.0, 50.0, 170.0)), item(3, "image", box=(50.0, 100.0, 90.0, 150.0), md="q")]
    df = spark.createDataFrame(rows, ITEM)
    assert [(r.node_ord, r.text_ord) for r in R.spatial_anchor(df).collect()] == [(1, 0)]
    assert [(r.node_ord, r.text_ord) for r in R.keyword_anchor(df).collect()] == [(1, 0)]


def test_zones_and_thresholds(spark):
    rows = [item(0, "paragraph", f"Page {p}", page=p) for p in range(1, 5)] + [item(1, "paragraph", "once", page=1, size=20.0), item(2, "image", page=2)]
    df = spark.createDataFrame(rows, ITEM)
    pages = spark.createDataFrame([(1, p) for p in range(1, 6)], "doc_id long, page_number int")
    zones = D.exclusion_zones(df, pages)
    assert [(r.zone, r.n) for r in zones.collect()] == [("Page", 4)]
    assert D.strip_exclusion(df, zones).count() == 2 and D.exclusion_zones(df, pages.limit(2)).count() == 0
    assert D.doc_heading_threshold(df.where("type = 'image'")).first().threshold == 14.0
    assert {r.ord for r in D.promote(df, D.doc_heading_threshold(df)).where("node_type = 'heading'").collect()} == {1}


def test_graph_is_connected_and_escaped(spark, tmp_path):
    rows = [item(0, "heading", "A <b>", size=16.0), item(1, "paragraph", "x" * 100), item(2, "heading", "B", size=12.0), item(3, "image"), item(0, "paragraph", "", page=2)]
    df = spark.createDataFrame(rows, ITEM)
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, page_number int")
    nodes, edges = R.weave_nodes(df, pages), R.weave_edges(df, pages)
    assert R.orphans(nodes, edges).count() == 0 and R.dangling(nodes, edges).count() == 0
    assert edges.groupBy("t").count().where("count > 1").count() == 0
    lines = [r.line for r in R.tree_lines(nodes, edges).orderBy("pos").collect()]
    assert lines[0] == "[FOLDER] [ROOT] Document" and "      [FILE] [PARAGRAPH] " + "x" * 80 + "..." in lines and len(lines) == 9
    html = R.html_render(nodes, edges).first().html
    assert "A &lt;b&gt;" in html and html.index("Page 1") < html.index("Page 2")
    sinks.write_bundle(nodes, edges, str(tmp_path / "b"))
    n, e = readers.read_bundle(spark, str(tmp_path / "b"))
    assert n.count() == nodes.count() and e.count() == edges.count()
    sinks.write_html(R.html_render(nodes, edges), str(tmp_path / "h"))
    sinks.write_pages(df, str(tmp_path / "p"))


def slow_tree(nodes, edges):
    """Pre-order with a set of visited nodes per root."""
    out, kids = [], {}
    for f, t in edges:
        kids.setdefault(f, []).append(t)

    def walk(n, level, seen):
        if n in seen:
            return
        seen.add(n)
        out.append((level, n))
        for k in kids.get(n, []):
            walk(k, level + 1, seen)

    for n in nodes:
        if n.startswith("r"):
            walk(n, 0, set())
    return out


@pytest.mark.parametrize("kind", ["chain", "cycle", "shared"])
def test_trees_of_any_depth(spark, kind):
    rng = random.Random(6)
    if kind == "chain":
        names = ["r0", *(f"n{i}" for i in range(40))]
        edges = list(zip(names, names[1:], strict=False))
    elif kind == "cycle":
        names = ["r0", "a", "b", "c", "d"]
        edges = [("r0", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "r0"), ("b", "d"), ("d", "d")]
    else:
        names = ["r0", "r1", *(f"n{i}" for i in range(25))]
        edges = list(dict.fromkeys((names[rng.randrange(min(27, 2 + i))], names[rng.randrange(2, 27)]) for i in range(60)))
    nodes = spark.createDataFrame([(1, n, "root" if n[0] == "r" else "paragraph", n, None) for n in names], "doc_id long, node_id string, t string, c string, b1 int")
    links = spark.createDataFrame([(1, f, t, "contains", 0, k) for k, (f, t) in enumerate(edges)], "doc_id long, f string, t string, r string, page_number int, ord int")
    got = [(r.level, r.line.split("] ")[-1]) for r in R.tree_lines(nodes, links).orderBy("pos").collect()]
    assert got == slow_tree(names, edges)


def test_gutters_without_a_histogram(spark):
    rng = random.Random(8)
    rows = [glyph(i, "x", rng.choice([-3, 0, 40, 41.5, 90, 200, 300, 580, 611, 640]) + rng.random() * rng.choice([0, 5, 30]), 100, page=1 + i % 20, width=rng.choice([0.0, 4.5, 9.0])) for i in range(160)]
    g = frame(spark, rows)
    key = lambda df: sorted((r.page_number, r.g0, r.g1) for r in df.collect())
    assert key(L.page_gutters(g)) == key(L.gutters(L.smoothed(L.coverage(g)))) and key(L.page_gutters(g))


def test_weave_compat(spark):
    rows = [item(0, "paragraph", "see Figure 3", (0.0, 0.0, 50.0, 40.0)), item(1, "image", box=(0.0, 60.0, 50.0, 150.0), md="p_3"), item(2, "heading", "H", (300.0, 500.0, 400.0, 520.0), size=20.0)]
    df = spark.createDataFrame(rows, ITEM).drop("node_type")
    pages = spark.createDataFrame([(1, 1)], "doc_id long, page_number int")
    kinds = lambda compat: sorted(r.r for r in PL.weave(df, pages, compat=compat)[1].collect())
    assert kinds(False) == ["body_text", "body_text", "contains", "contains", "keyword_anchor", "visual_evidence"]
    assert kinds(True) == ["body_text", "body_text", "contains", "contains"]
    assert [r.semantic_context.text_above for r in PL.link(df).where("type = 'image'").collect()] == ["see Figure 3"]


def test_files_and_arrivals(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1")
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def opener(content):
        if content == b"!":
            raise ValueError("broken")
        yield {"width": 612.0, "height": 792.0, "chars": [{"text": "a", "x0": 1.005, "x1": 2.0, "top": 3.0, "bottom": 4.0}]}

    files = readers.document_files(spark, str(tmp_path))
    got = readers.decode_glyphs(files, opener).collect()
    assert len(got) == 2 and {(r.text, r.error) for r in got} == {("a", None), (None, "ValueError: broken")}
    with pytest.raises(FileNotFoundError):
        readers.document_files(spark, str(tmp_path), "*.none")
    pages = spark.createDataFrame([("p", 1, True), ("p", 2, True), ("p", 3, False)], "path string, page_number int, corrupt boolean")
    texts = readers.recover_pages(pages, lambda p, n: " text " if n == 1 else None).collect()
    assert [(r.page_number, r.text) for r in texts] == [(1, "text")]
    frame(spark, [glyph(0, "a", 50, 100)]).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        parse_arrivals(spark, str(tmp_path / "in"), frame(spark, []).schema, lambda df, i: L.parse(df, boxes(spark)).write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(f"{out}/0").count() == 1
