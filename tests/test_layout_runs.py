"""Runs of glyphs against the same glyphs as rows, and the fixtures' runs against their glyphs."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegraph.config import PAGE
from pagegraph.operators import glyphs as G
from pagegraph.operators import layout as L
from pagegraph.operators import pages as PG
from pagegraph.plans import fixtures as FX
from pagegraph.plans import registry

from .test_layout_plans import FIELDS, above, odd  # noqa: F401
from .test_oracles import SF, rows

NUMBERS = ["step", "top", "bottom", "size", "width", "each", "a", "b", "page_width", "page_height"]


def test_text_blocks_neither_sorts_nor_keeps_glyphs(spark):
    """As rows, a GB's billion glyphs were sorted twice and collected by block."""
    found = above(registry.queries()["text_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(found) == 1
    assert not [x for x in found[0] if re.match(r"Sort|Window|\w*Aggregate|Exchange", x)]


def each_row(t, raw, chars, at):
    """A run for each row."""
    column = {k: t.column(k).to_numpy() for k in ("seq", "x0", *NUMBERS)}
    page = np.cumsum(PG._starts(*(t.column(k).chunk(0).dictionary_encode().indices.to_numpy() for k in PAGE))) - 1
    return column | {"page": page, "n": np.diff(at), "char": at[:-1]}


def odd_runs(kind: str) -> tuple[list, list]:
    """Runs and boxes: words in columns; runs that lie on each other, run backwards or stand still, have gaps or no height, are turned; boxes that cut runs."""
    rng = random.Random(kind)
    out, boxes = [], [("p1", 1, 100.0, 90.0, 171.0, 300.0), ("p1", 1, 95.0, 200.0, 110.5, 400.0), ("p2", 1, 0.0, 0.0, 700.0, 800.0), ("p3", 1, None, 0.0, 700.0, 800.0)]
    for doc, page in [("p1", 1), ("p1", 2), ("p2", 1), ("p3", 1), ("ä", 7), (None, 1), ("p4", None), *((f"q{k}", 1) for k in range(12))]:
        seq = 0
        for _ in range(rng.choice([1, 20, 150])):
            x, y = rng.choice([50, 330]) + 6.0 * rng.randrange(30), 30 + 14.5 * rng.randrange(50) + rng.choice([0, 0, 0.4])
            size, height, step, a, b = rng.choice([10.0, 10.0, 10.25, 8.15, 16.0]), None, 5.0, 1.0, 0.0
            if kind == "odd":
                height, step = rng.choice([None, None, None, 0.0, -8.0]), rng.choice([5.0, 5.0, 5.5, 6.5, 9.0, 0.0, -5.0])
                a, b = rng.choice([(1.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 1.0), (0.8358, 0.549), (-1.0, 0.0)])
            if kind == "apart":  # no run meets another
                x, y = 50.0 + 280 * rng.randrange(2) + 40 * rng.randrange(6) - 2 * (seq % 3), 60.0 + 12 * seq % 700
            text = "".join(rng.choice(["a", "b", "-", "é", " ", "\U0001f600", "\x1f", "x", "y"]) for _ in range(rng.choice([1, 2, 5, 7])))
            out.append((doc, page, seq, text, x, step, y, y + (size if height is None else height), size, 4.5, 4.5, a, b, 612.0, 792.0))
            seq += 10
    return out, boxes


@pytest.mark.parametrize("kind", ["apart", "words", "odd"])
@pytest.mark.parametrize("group", [1, 1 << 18])
def test_runs_are_laid_out_as_their_glyphs(spark, monkeypatch, kind, group):
    monkeypatch.setattr(PG, "BYTES", group)
    runs, boxes = odd_runs(kind)
    b = spark.createDataFrame(boxes, "doc_id string, page_number int, x0 double, top double, x1 double, bottom double")
    numbers = ", ".join(f"{k} double" for k in NUMBERS)
    pieces = spark.createDataFrame(runs, f"doc_id string, page_number int, seq long, text string, x0 double, {numbers}")
    glyphs = pieces.select("*", F.posexplode(F.split("text", "")).alias("i", "one")).where("one <> ''").withColumns({"seq": F.col("seq") + F.col("i"), "text": F.col("one"), "x0": F.col("x0") + F.col("i") * F.col("step")})
    glyphs = glyphs.withColumns({"x1": F.col("x0") + F.col("each"), "matrix": F.array("a", "b")}).select(*PAGE, "seq", "text", "size", "x0", "top", "x1", "bottom", "width", "matrix", "page_width", "page_height").cache()
    safe = G.with_angle(G.safe_zone(glyphs))
    kept = L.normalised(L.mask(safe, b))
    found = L.blocks(L.spaced(L.columns(L.slices(L.lines(kept)), L.page_gutters(safe))), G.page_metrics(kept))
    for merge, want in ((False, found), (True, L.merged(found))):
        got = PG.run_blocks(pieces.repartition(3, *PAGE).sortWithinPartitions(*PAGE), each_row, b, merge=merge).toPandas()
        assert rows(got[[*PAGE, *FIELDS]]) == rows(want.select(*PAGE, *FIELDS).toPandas()) and len(got) > 100
        assert rows(got) == rows(PG.page_blocks(glyphs, b, merge=merge).toPandas())


def test_few_runs_are_taken_apart(monkeypatch):
    """Words that no box cuts stay whole."""
    seen = []
    monkeypatch.setattr(PG, "_placed", lambda page, v, *a, f=PG._placed: seen.append(v["n"]) or f(page, v, *a))
    one = {"page": [0, 0, 0], "seq": [0, 10, 20], "n": [4, 4, 4], "char": [0, 4, 8], "x0": [50.0, 80.0, 110.0], "top": [60.0] * 3, "bottom": [70.0] * 3, "size": [10.0] * 3, "step": [5.0] * 3, "width": [4.5] * 3, "each": [4.5] * 3, "a": [1.0] * 3, "b": [0.0] * 3, "page_width": [612.0] * 3, "page_height": [792.0] * 3}
    box = pa.array([[{"x0": 90.0, "top": 0.0, "x1": 100.0, "bottom": 100.0}]])
    out = PG._runs_laid({k: np.array(x) for k, x in one.items()}, np.frombuffer(b"wordsomemore", np.uint8), np.arange(13), {"doc_id": pa.array([1]), "page_number": pa.array([1])}, box, PG.DEFAULT, False)
    assert [x.tolist() for x in seen] == [[4, 1, 1, 1, 1, 4]] and out.column("text").to_pylist() == ["word so more"]


def test_runs_of_texts_are_their_glyphs(spark, odd):  # noqa: F811
    """The fixtures' runs, taken apart, are their glyphs."""
    for d in (odd, SF):
        want = FX.glyphs(spark, d).where("doc_id is not null").selectExpr("*", "matrix[0] as a", "matrix[1] as b").drop("matrix").toPandas()
        t = FX.page_pieces(spark, d).where("doc_id is not null").sort(*PAGE, "piece").toArrow().combine_chunks()
        raw, chars, at = PG.characters(t)
        r = FX.glyph_runs(t, raw, chars, at)
        assert (r["n"] > 1).any() and (r["n"] > 0).all()
        r = PG._apart(r, r["n"] > 0)
        first = PG._starts(*(t.column(k).to_numpy() for k in PAGE))
        got = pd.DataFrame({k: t.column(k).to_numpy()[first][r["page"]] for k in PAGE} | {k: x for k, x in r.items() if k not in ("page", "n", "char", "step", "each")})
        got["x1"], got["text"] = got["x0"] + r["each"], [bytes(raw[chars[k] : chars[k + 1]]).decode() for k in r["char"]]
        assert rows(got) == rows(want)
