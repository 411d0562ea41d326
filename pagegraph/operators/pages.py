"""Page layout over arrays: the rules of ``layout`` for whole pages at a time, without sorting or keeping rows of glyphs.

A GB of texts is over a billion glyphs. As rows they are sorted twice, and collecting a block's glyphs buffers all of a
task's again, which takes memory and then disk. Here a task holds some pages' glyphs as arrays, lays them out, and hands
on their blocks. ``layout`` has the same rules as DataFrame operations, and the tests compare both.

A source that knows its glyphs as runs (characters that follow each other at an even step in one line and font) need not
make rows of them at all: ``run_blocks`` lays out runs, and makes glyphs only of those that a rule takes apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, PAGE, Layout
from ..functions.text import rotation_angle
from .glyphs import safe_zone

ROWS = 1 << 16  #: glyphs that are laid out at once, at least; a page is never cut
BYTES = 1 << 18  #: bytes of text whose runs are laid out at once, at least; a page is never cut
#: What Unicode calls white space (``\s`` of the rows' rule).
BLANK = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
NUMBERS = ["size", "x0", "top", "x1", "bottom", "width", "page_width", "angle"]


def _codes(a: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct values in order, and these values."""
    found = (a if isinstance(a, pa.Array) else pa.array(a)).dictionary_encode()
    values, place = np.unique(found.dictionary.to_numpy(zero_copy_only=False), return_inverse=True)
    return place[found.indices.to_numpy()], values


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the row before."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return first


def _within(first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Running sums of ``step`` that begin anew at each ``first``."""
    total = np.cumsum(step)
    at = np.flatnonzero(first)
    return total - np.repeat(total[at] - step[at], np.diff(np.append(at, len(first))))


def _gutters(page: np.ndarray, begin: np.ndarray, v: dict, cfg: Layout) -> list[tuple[np.ndarray, np.ndarray]]:
    """g0 and g1 of each page's first, second, ... gutter (NaN without), as ``layout.page_gutters``."""
    w = v["page_width"].astype(np.int64)
    lo, hi = np.maximum(0, v["x0"].astype(np.int64)), np.minimum(w, v["x1"].astype(np.int64) + 1)
    n, wide = len(begin), np.maximum.reduceat(w, begin)
    mean = np.add.reduceat(v["each"] * v["n"], begin) / np.add.reduceat(v["n"], begin)
    on = hi > lo
    p, lo, hi = page[on], lo[on], hi[on]
    most = int(hi.max(initial=0)) + 1
    if n * most < 2**62 // most:
        key = np.sort((p * most + lo) * most + hi)
        p, lo, hi = key // (most * most), key // most % most, key % most
    else:
        order = np.lexsort((hi, lo, p))
        p, lo, hi = p[order], lo[order], hi[order]
    reach = np.maximum.accumulate(p * most + hi)  # begins anew with the page
    before = np.concatenate(([-1], reach[:-1])) - p * most
    g0, g1 = np.where(before >= 0, before + cfg.blur, 0), lo - cfg.blur
    at = np.flatnonzero(g1 > g0)
    at = at[(g1[at] < wide[p[at]]) & (g1[at] - g0[at] > cfg.gutter_width * mean[p[at]])]
    p, g0, g1 = p[at], g0[at], g1[at]
    place = _within(_starts(p), np.ones(len(p), np.int64)) if len(p) else p
    out = []
    for k in range(1, int(place.max(initial=0)) + 1):
        a, b = np.full(n, np.nan), np.full(n, np.nan)
        a[p[place == k]], b[p[place == k]] = g0[place == k], g1[place == k]
        out.append((a, b))
    return out


def _thresholds(bucket: np.ndarray, n: int, size: np.ndarray, seq: np.ndarray, weight: np.ndarray, cfg: Layout) -> tuple[np.ndarray, np.ndarray]:
    """heading_threshold and first_seq by bucket, as ``glyphs.page_metrics``; ``weight``: a row's glyphs."""
    code, sizes = _codes(size)
    rounded = np.array([float(Decimal(repr(float(s))).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) if math.isfinite(s) else s for s in sizes])
    values, place = np.unique(rounded, return_inverse=True)
    key, found = _codes(bucket * len(values) + place[code])
    count, first = np.bincount(key, weight, len(found)), np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(first, key, seq)
    b, s = found // len(values), values[found % len(values)]
    c, total, squares = (np.bincount(b, count * s**k, n) for k in range(3))
    order = np.lexsort((first, -count, b))
    mode = np.zeros(n)
    at = order[_starts(b[order])]
    mode[b[at]] = s[at]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, b, first)
    sd = np.where(c > 1, np.sqrt(np.maximum(0.0, (squares - total * total / c) / np.maximum(c - 1, 1))), 0.0)
    return np.where(sd > cfg.heading_min_sd, mode + cfg.heading_sd * sd, mode * cfg.heading_mode), least


def _texts(raw: np.ndarray, first: np.ndarray, count: np.ndarray, gap: np.ndarray, at: np.ndarray) -> pa.Array:
    """Pieces of ``raw``, with a space before where ``gap`` says so, as one text from each ``at`` on, without white space at its ends."""
    ends = np.concatenate(([0], np.cumsum(count + gap)))
    to, own = ends[:-1] + gap, count > 0
    step = np.ones(ends[-1], np.int64)
    step[to[own]] = first[own]
    step[to[own][1:]] -= (first[own] + count[own] - 1)[:-1]
    step[ends[:-1][gap > 0]] = 0
    out = np.append(raw, np.uint8(0))[np.cumsum(step)]
    out[ends[:-1][gap > 0]] = 32
    whole = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(ends[at], ends[-1])), pa.py_buffer(out)])
    return pc.utf8_trim(whole, BLANK)


def _merged(rows: dict[str, list], cfg: Layout) -> dict[str, list]:
    """Adjacent blocks that belong together, as ``layout.merged``; rows come by bucket, slice, column and block."""
    out: dict[str, list] = {k: [] for k in rows}
    cur = None

    def close() -> None:
        for k, x in cur.items():
            out[k].append(x)

    for values in zip(*rows.values(), strict=True):
        x = dict(zip(rows, values, strict=True))
        if cur and all(cur[k] == x[k] for k in ("bucket", "slice", "column_id", "type")) and abs(x["ntop"] - cur["nbottom"]) < cur["font_size"] * cfg.merge_gap:
            cur["text"] = cur["text"][:-1] + x["text"] if cur["text"].endswith("-") else f"{cur['text']} {x['text']}"
            cur |= {"x0": min(cur["x0"], x["x0"]), "top": min(cur["top"], x["top"]), "x1": max(cur["x1"], x["x1"]), "bottom": max(cur["bottom"], x["bottom"]), "nbottom": x["nbottom"]}
        else:
            if cur:
                close()
            cur = x
    if cur:
        close()
    return out


class _Meet(Exception):
    """Runs lie in each other's way, so that glyphs of one come between those of another."""


def _laid(t: pa.Table, cfg: Layout, merge: bool) -> pa.Table | None:
    """The blocks of whole pages, whose glyphs follow each other."""
    t = t.combine_chunks()
    column = {k: t.column(k).chunk(0) for k in t.column_names}
    first = _starts(*(column[k].dictionary_encode().indices.to_numpy() for k in PAGE))
    v = {k: column[k].to_numpy(zero_copy_only=False) for k in NUMBERS}
    v |= {"seq": column["seq"].to_numpy(), "n": np.ones(len(t), np.int64), "last": v["x0"], "each": v["x1"] - v["x0"]}
    text = column["text"].cast(pa.large_string())
    valid = text.is_valid().to_numpy(zero_copy_only=False)
    text = pc.fill_null(text, "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    spans = np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:] - offsets[:-1], valid
    return _placed(np.cumsum(first) - 1, v, column["covered"].to_numpy(zero_copy_only=False), spans, {k: column[k].filter(pa.array(first)) for k in PAGE}, cfg, merge)


def _placed(page: np.ndarray, v: dict, covered: np.ndarray, spans: tuple, keys: dict[str, pa.Array], cfg: Layout, merge: bool) -> pa.Table | None:
    """The blocks of whole pages: 0, 1, ..., named by ``keys``.

    v: a row for each glyph, or for ``n`` glyphs whose first begins at x0, whose last begins at ``last`` and ends at x1,
    and that no rule takes apart; each is ``each`` wide. spans: bytes, where each row's text begins in them, its length,
    and whether it has one (None: all have).
    """
    begin = np.flatnonzero(_starts(page))
    found = _gutters(page, begin, v, cfg)

    kept = np.flatnonzero(~covered)
    if not len(kept):
        return None
    page, seq = page[kept], v["seq"][kept]
    v = {k: x[kept] for k, x in v.items()}
    height, (turn, angles) = np.abs(v["bottom"] - v["top"]), _codes(v["angle"])
    v |= {"nx0": v["x0"], "nx1": v["x1"], "ntop": v["top"], "nbottom": v["bottom"]}
    if (angles != 0).any():
        turned = np.flatnonzero(v["angle"] != 0)
        c, s = (np.array([f(math.radians(-a)) for a in angles])[turn[turned]] for f in (math.cos, math.sin))
        cx, cy = (v["x0"][turned] + v["x1"][turned]) / 2, (v["top"][turned] + v["bottom"][turned]) / 2
        nx, ny, w, h = cx * c - cy * s, cx * s + cy * c, v["width"][turned] / 2, height[turned] / 2
        for k, x in {"nx0": nx - w, "nx1": nx + w, "ntop": ny - h, "nbottom": ny + h}.items():
            v[k] = v[k].copy()
            v[k][turned] = x

    # as they follow each other on the page: by page, angle, ntop, nx0, seq
    (down, downs), (along, alongs) = _codes(v["ntop"]), _codes(v["nx0"])
    group = page * len(angles) + turn
    if (np.diff(seq)[page[1:] == page[:-1]] < 0).any() or len(begin) * len(angles) * len(downs) * len(alongs) >= 2**62:
        order = np.lexsort((seq, along, down, group))
    else:
        order = np.argsort((group * len(downs) + down) * len(alongs) + along, kind="stable")
    page, seq, group, height = page[order], seq[order], group[order], height[order]
    v = {k: x[order] for k, x in v.items() if k not in ("width", "page_width", "each", "seq")}
    n = v["n"]
    if ((n[:-1] > 1) & (group[1:] == group[:-1]) & (v["ntop"][1:] == v["ntop"][:-1]) & (v["nx0"][1:] <= v["last"][:-1])).any():
        raise _Meet
    opens = _starts(group)
    at = np.flatnonzero(opens)
    bucket, mean = np.cumsum(opens) - 1, np.add.reduceat(height * n, at) / np.add.reduceat(n, at)
    high, first_seq = _thresholds(bucket, len(at), v["size"], seq, n, cfg)

    # lines and slices
    new = opens.copy()
    new[1:] |= np.abs(v["ntop"][1:] - v["ntop"][:-1]) >= cfg.line_glue * mean[bucket[1:]]
    line = np.flatnonzero(new)
    end = np.maximum.reduceat(v["nbottom"], line)
    cut = opens[line].copy()
    cut[1:] |= v["ntop"][line[1:]] - end[:-1] >= cfg.slice_gap * mean[bucket[line[1:]]]
    at = line[cut]
    number = _within(opens[at], np.ones(len(at), np.int64))
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(group))))

    # columns: the gutter that holds a slice's middle
    least, most = np.minimum.reduceat(v["nx0"], at), np.maximum.reduceat(v["nx1"], at)
    middle = least + (most - least) / 2
    left, right = np.full(len(at), np.inf), np.full(len(at), np.inf)
    for a, b in found:
        g0, g1 = a[page[at]], b[page[at]]
        holds = (least < g0) & (g1 < most) & (g0 < middle) & (middle < g1)
        left[holds], right[holds] = g0[holds], g1[holds]
    none = np.isinf(left)[of]
    sides = [none, ~none & (v["nx1"] <= left[of]), ~none & (v["nx1"] > left[of]) & (v["nx0"] >= right[of])]

    # blocks: a column's glyphs keep the order of their slice
    which = [np.flatnonzero(x) for x in sides]
    side, own = np.repeat(np.arange(3), [len(x) for x in which]), np.concatenate(which)
    if not len(own):
        return None
    v, of = {k: x[own] for k, x in v.items()}, of[own]
    head = _starts(of, side)
    cut, gap, size = head.copy(), ~head, v["size"]
    cut[1:] |= (v["ntop"][1:] - v["nbottom"][:-1] > cfg.block_gap * size[:-1]) | (np.abs(size[1:] - size[:-1]) > cfg.block_size)
    gap[1:] &= (np.abs(v["ntop"][1:] - v["ntop"][:-1]) < cfg.space_line * size[1:]) & (v["nx0"][1:] - v["nx1"][:-1] > cfg.space_gap * size[1:])
    at = np.flatnonzero(cut)
    b = bucket[own[at]]
    font = np.add.reduceat(size * v["n"], at) / np.add.reduceat(v["n"], at)
    rows = {
        "bucket": b, "page": page[own[at]], "angle": v["angle"][at], "slice": number[of[at]], "column_id": side[at], "block": _within(head, cut.astype(np.int64))[at],
        "first_seq": first_seq[b], "type": np.where(font >= high[b], "heading", "paragraph"), "font_size": font,
        **{k: np.minimum.reduceat(v[k], at) for k in ("x0", "top", "ntop")}, **{k: np.maximum.reduceat(v[k], at) for k in ("x1", "bottom", "nbottom")},
    }
    rows["head_top"] = rows["top"]
    by = np.lexsort((rows["block"], rows["column_id"], rows["slice"], b))
    whence = kept[order[own]]
    raw, first, count, valid = spans
    gap = gap & ~cut if valid is None else gap & ~cut & valid[whence]
    texts = _texts(raw, first[whence], count[whence], gap.astype(np.int64), at)
    lists = {k: x[by] for k, x in rows.items()} | {"text": texts.take(pa.array(by))}
    if merge:
        lists = _merged({k: x.tolist() for k, x in lists.items()}, cfg)

    # reading order: columns, then what spans them, by top; ties by arrival
    col = np.array(lists["column_id"])
    pages = np.array(lists["page"])
    by = np.lexsort((lists["block"], col, lists["slice"], lists["first_seq"], lists["head_top"], np.where(col == 0, 999, col), pages))
    place = np.empty(len(by), np.int64)
    place[by] = _within(_starts(pages[by]), np.ones(len(by), np.int64))
    whose = pa.array(pages)
    return pa.table({k: keys[k].take(whose) for k in PAGE} | {k: lists[k] if isinstance(lists[k], pa.Array) else pa.array(lists[k]) for k in _FIELDS if k != "ord"} | {"ord": pa.array(place)})


_FIELDS = {"angle": "double", "slice": "long", "column_id": "int", "block": "long", "first_seq": "long", "text": "string", "type": "string", "font_size": "double", "x0": "double", "top": "double", "x1": "double", "bottom": "double", "ntop": "double", "nbottom": "double", "head_top": "double", "ord": "int"}


def _whole_pages(batches: Iterator[pa.RecordBatch], least: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole pages of ``least`` rows or a little more; a page's rows follow each other."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        last = b.slice(b.num_rows - 1).select(PAGE).to_pylist()[0]
        keep = np.ones(b.num_rows, bool)
        for k in PAGE:
            keep &= pc.equal(b.column(k), pa.scalar(last[k], b.schema.field(k).type)).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~keep)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
            n = held[0].num_rows
        elif len(held) > 1 and held[-2].slice(held[-2].num_rows - 1).select(PAGE).to_pylist()[0] != last:
            yield pa.Table.from_batches(held[:-1])
            held, n = [b], b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def page_blocks(glyphs: DataFrame, boxes: DataFrame, cfg: Layout = DEFAULT, merge: bool = True, by_page: bool = False) -> DataFrame:
    """Blocks of the glyphs outside ``boxes``, merged if asked for, with ``ord`` from 1 in reading order.

    ``by_page``: a page's glyphs follow each other already; others are dealt and sorted by page first. As in the SQL,
    what belongs to no document or page is in no line.
    """
    if cfg.blur > 4:
        raise ValueError("gutters by covered stretches need a blur of 4 at most")
    level = (F.try_element_at("matrix", F.lit(2)) == 0) & (F.try_element_at("matrix", F.lit(1)) > 0)  # most are: spares them the angle's rounding
    g = safe_zone(glyphs, cfg).where("doc_id is not null and page_number is not null")
    g = g.withColumn("angle", F.when(level, F.lit(0.0)).otherwise(rotation_angle(F.col("matrix")))).alias("_g")
    b = boxes.select(*(F.col(c).alias(f"_{c}") for c in (*PAGE, "x0", "top", "x1", "bottom"))).hint("shuffle_hash")
    o = {c: F.col(f"_g.{c}").outer() for c in (*PAGE, "x0", "top", "bottom")}
    inside = (o["x0"] >= F.col("_x0")) & (o["x0"] <= F.col("_x1")) & (o["top"] >= F.col("_top")) & (o["bottom"] <= F.col("_bottom"))
    covers = b.where((F.col("_doc_id") == o["doc_id"]) & (F.col("_page_number") == o["page_number"]) & inside)
    g = g.select(*PAGE, F.col("seq").cast("long").alias("seq"), "text", *(F.col(c).cast("double").alias(c) for c in NUMBERS), covers.exists().alias("covered"))
    if not by_page:
        g = g.repartition(*PAGE).sortWithinPartitions(*PAGE)
    schema = T.StructType([*(g.schema[k] for k in PAGE), *(T.StructField(k, T._parse_datatype_string(t)) for k, t in _FIELDS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pages(batches):
            out = _laid(t, cfg, merge)
            if out is not None:
                yield from _cast(out).to_batches()

    return g.mapInArrow(run, schema)


def _cast(out: pa.Table) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return out.cast(pa.schema([pa.field(k, out.schema.field(k).type) for k in PAGE] + [pa.field(k, kinds[x]) for k, x in _FIELDS.items()]))


def _apart(r: dict, which: np.ndarray) -> dict:
    """The runs of ``which`` as one run for each glyph."""
    times = np.where(which, r["n"], 1)
    of = np.repeat(np.arange(len(times)), times)
    i = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    r = {k: x[of] for k, x in r.items()}
    return r | {"n": np.where(which[of], 1, r["n"]), "x0": r["x0"] + i * r["step"], "seq": r["seq"] + i, "char": r["char"] + i}


def _covered(r: dict, boxes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Runs of which boxes of their page cover all glyphs, and those that a box covers in part. boxes: a list for each page."""
    whole, part = np.zeros(len(r["n"]), bool), np.zeros(len(r["n"]), bool)
    if boxes.null_count == len(boxes):
        return whole, part
    many = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False)
    flat = boxes.flatten()
    b = {k: flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x0", "top", "x1", "bottom")}
    begin, rows = np.cumsum(many) - many, np.arange(len(whole))
    for j in range(int(many.max(initial=0))):
        rows = rows[many[r["page"][rows]] > j]
        one = begin[r["page"][rows]] + j
        inside = (r["top"][rows] >= b["top"][one]) & (r["bottom"][rows] <= b["bottom"][one])
        at, one = rows[inside], one[inside]
        left, right, x0, x1 = r["x0"][at], r["x0"][at] + (r["n"][at] - 1) * r["step"][at], b["x0"][one], b["x1"][one]
        whole[at] |= (left >= x0) & (right <= x1)
        part[at] |= (left <= x1) & (right >= x0)
    return whole, part & ~whole


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees of matrices, as ``rotation_angle``."""
    out, turned = np.zeros(len(a)), np.flatnonzero((b != 0) | (a <= 0))
    if len(turned):
        (of, values), (at, others) = _codes(a[turned]), _codes(b[turned])
        key, pairs = _codes(of * len(others) + at)
        degrees = [math.fmod(math.degrees(math.atan2(others[k % len(others)], values[k // len(others)])), 360.0) for k in pairs.tolist()]
        degrees = [math.fmod(x + 360.0, 360.0) if x < 0 else x for x in degrees]
        out[turned] = np.array([float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for x in degrees])[key]
    return out


def _runs_laid(r: dict, raw: np.ndarray, chars: np.ndarray, keys: dict[str, pa.Array], boxes: pa.Array, cfg: Layout, merge: bool) -> pa.Table | None:
    """The blocks of whole pages' runs. chars: where each character of ``raw`` begins, and where the last one ends."""
    safe = (r["top"] > cfg.safe_top * r["page_height"]) & (r["top"] < cfg.safe_bottom * r["page_height"])
    r = {k: x[safe] for k, x in r.items()}
    if not safe.any():
        return None
    r["angle"] = _angles(r.pop("a"), r.pop("b"))
    # what keeps a run's glyphs in one line, column and block without a space or a gutter between them; near a limit, glyphs decide
    plain = min(cfg.line_glue, cfg.space_line) > 0 and min(cfg.block_gap, cfg.block_size) >= 0
    tight = plain & (r["angle"] == 0) & (r["size"] > 0) & (r["bottom"] > r["top"]) & (r["step"] > 0) & (r["step"] - r["each"] < np.minimum(1.0, cfg.space_gap * r["size"]) - 1e-6)
    loose = ~tight & (r["n"] > 1)
    if loose.any():
        r = _apart(r, loose)
    covered, part = _covered(r, boxes)
    if part.any():
        r = _apart(r, part)
        covered, _ = _covered(r, boxes)
    for _ in range(2):
        last = r["x0"] + (r["n"] - 1) * r["step"]
        v = {k: r[k] for k in ("seq", "n", "each", "size", "x0", "top", "bottom", "width", "page_width", "angle")} | {"last": last, "x1": last + r["each"]}
        first = chars[r["char"]]
        opens = _starts(r["page"])
        page, names = np.cumsum(opens) - 1, {k: x.take(pa.array(r["page"][opens])) for k, x in keys.items()}
        try:
            return _placed(page, v, covered, (raw, first, chars[r["char"] + r["n"]] - first, None), names, cfg, merge)
        except _Meet:
            covered = np.repeat(covered, r["n"])
            r = _apart(r, r["n"] > 1)
    raise AssertionError("glyphs can't lie in each other's way")


def _groups(t: pa.Table) -> Iterator[pa.Table]:
    """The whole pages of a table in parts of BYTES of text or a little more."""
    t = t.combine_chunks()
    begin = np.flatnonzero(_starts(*(t.column(k).chunk(0).dictionary_encode().indices.to_numpy() for k in PAGE)))
    size = np.concatenate(([0], np.cumsum(pc.binary_length(t.column("text")).to_numpy())))[begin] // BYTES
    cuts = [*begin[_starts(size)].tolist(), len(t)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield t.slice(a, b - a)


def run_blocks(pieces: DataFrame, runs: Callable[..., dict], boxes: DataFrame, cfg: Layout = DEFAULT, merge: bool = True) -> DataFrame:
    """``page_blocks`` of glyphs that ``runs`` makes, as runs, of pages' ``pieces`` in the task that lays them out.

    pieces: rows with a ``text``; a page's rows follow each other. runs: of a table of whole pages and what ``characters``
    says of it, an array for each of page (its place among the table's pages, in order), seq, n, char, x0, step, top,
    bottom, size, width, each, a, b, page_width and page_height. A run has n glyphs, one at least: the characters of the
    pieces' texts from ``char`` on, within one piece, each at ``step`` from the one before; a and b are its matrix's first
    values, ``each`` is x1 - x0 of a glyph.
    """
    if cfg.blur > 4:
        raise ValueError("gutters by covered stretches need a blur of 4 at most")
    per_page = boxes.select(*(F.col(c).alias(f"_{c}") for c in PAGE), F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom"))).alias("_b")).groupBy("_doc_id", "_page_number").agg(F.collect_list("_b").alias("_boxes"))
    p = pieces.where("doc_id is not null and page_number is not null")
    p = p.join(per_page.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_number") == F.col("_page_number")), "left").drop("_doc_id", "_page_number")
    schema = T.StructType([*(p.schema[k] for k in PAGE), *(T.StructField(k, T._parse_datatype_string(t)) for k, t in _FIELDS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_pages(batches, 1):
            for t in _groups(whole):
                t = t.combine_chunks()
                raw, chars, at = characters(t)
                first = pa.array(_starts(*(t.column(k).chunk(0).dictionary_encode().indices.to_numpy() for k in PAGE)))
                out = _runs_laid(runs(t, raw, chars, at), raw, chars, {k: t.column(k).chunk(0).filter(first) for k in PAGE}, t.column("_boxes").chunk(0).filter(first), cfg, merge)
                if out is not None:
                    yield from _cast(out).to_batches()

    return p.mapInArrow(run, schema)


def characters(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a table's texts: their bytes, where each character begins in them (and the last one ends), and each text's first character (and the last one's end)."""
    text = t.column("text").chunk(0).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw) or raw.max() < 128:
        return raw, np.arange(len(raw) + 1), offsets
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    chars = np.append(lead, len(raw))
    return raw, chars, np.searchsorted(chars, offsets)
