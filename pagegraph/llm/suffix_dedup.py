"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere are removed.

Suffixes are sampled by content, so that both places of any repeated 200-byte string hold a sampled suffix at
the same offset (winnowing: the least hash of 100-byte grams in every window of 101). Then

1. every run of documents sends its sorted, distinct gram hashes by hash range; what comes back is one bit each:
   does the gram occur again? Only such suffixes can lie in a repeat;
2. their contexts (200 bytes on, then 100 bytes back, read backwards) are sorted within the run, cut by range,
   front-coded against the run's predecessor and exchanged. A loser tree merges a range's runs, carrying common
   prefix lengths with the last output, so known prefixes are never compared again;
3. suffixes of a merged range with common prefixes of at least 200 - j bytes and equal j bytes before them share
   a 200-byte string that starts j bytes before the suffix. The least and greatest such j return to the run, which
   removes the bytes between and hashes the rest.

Equal contexts of one run travel once, so a group of copies costs a range no more rows than there are runs. Runs
have a bounded number of bytes, follow from doc_id and text alone and give the same entries whatever the row order, so a
lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, partitions, release, table, text_buffers

WIDTH, GRAM = 200, 100
BACK = WIDTH - GRAM  #: the most bytes by which a shared string can start before its sampled suffix
RUN_BYTES = 4 << 20
RANGE_BYTES, TASK_BYTES = 8 << 20, 64 << 20  #: text whose suffixes meet in one range, and text in one task
SLAB = 1 << 17
PAD = 0xFF  #: never occurs in UTF-8
NONE = 255
BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value per byte, powers of the base and of its inverse (all mod 2^64)."""
    n = SLAB + 2 * WIDTH + GRAM
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)), np.cumprod(up), np.cumprod(down)


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for every i with w values on, by block-wise running values from both sides."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    fill = np.iinfo(x.dtype).max if op is np.minimum else 0
    y = np.full(blocks * w, fill, x.dtype)
    y[: len(x)] = x
    y = y.reshape(blocks, w)
    on = op.accumulate(y, axis=1).ravel()
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], on[w - 1 : w - 1 + n])


def sampled(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the sampled suffixes of all texts (bytes laid end to end)."""
    values, up, down = _tables()
    at, hashes = [], []
    top = np.iinfo(np.uint64).max
    for a in range(0, len(raw), SLAB):
        lo, hi = max(0, a - BACK), min(len(raw), a + SLAB + WIDTH)
        n = hi - lo
        if n < WIDTH:
            continue
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(values[raw[lo:hi]] * up[:n], out=s[1:])
        h = mix64((s[GRAM:] - s[:-GRAM]) * down[: n - GRAM + 1])
        h[h == top] = top - np.uint64(1)
        # grams and windows that reach over a text's end don't count
        ends = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi + WIDTH, side="right")].tolist()
        for e in ends:
            h[max(0, e - GRAM + 1 - lo) : e - lo] = top
        least = _sliding(h, BACK + 1, np.minimum)
        for e in ends:
            least[max(0, e - WIDTH + 1 - lo) : e - lo] = 0
        least[least == top] = 0
        padded = np.concatenate((np.zeros(BACK, np.uint64), least, np.zeros(max(0, len(h) - len(least)), np.uint64)))
        most = _sliding(padded, BACK + 1, np.maximum)[: len(h)]
        keep = np.flatnonzero(most == h[: len(most)])
        keep = keep[(keep + lo >= a) & (keep + lo < a + SLAB)]
        at.append(keep + lo)
        hashes.append(h[keep])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at).astype(np.int64), np.concatenate(hashes)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _blocks(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, start, end) of the stretches of a sorted range column."""
    if not len(keys):
        return []
    edge = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    return [(int(keys[i]), int(i), int(j)) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"_run": pa.array(cols[0], pa.int64()), "_kind": pa.array(cols[1], pa.int32()), "_range": pa.array(cols[2], pa.int64()), "_data": pa.array(cols[3], pa.binary())})


EXCHANGE = "_run long, _kind int, _range long, _data binary"


class Run:
    """The sampled suffixes of one run of documents."""

    def __init__(self, texts, ranges: int):
        self.raw, self.offsets = text_buffers(texts)
        self.ranges = ranges
        self.at, self.h = sampled(self.raw, self.offsets)
        self.distinct, self.which, self.counts = np.unique(self.h, return_inverse=True, return_counts=True)

    def gram_blocks(self):
        """Blobs of the distinct hashes by range: hashes, then a byte each that says if it repeats in this run."""
        for r, i, j in _blocks(_range_of(self.distinct, self.ranges)):
            yield r, self.distinct[i:j].tobytes() + (self.counts[i:j] > 1).astype(np.uint8).tobytes()

    def keep_repeated(self, bits: dict[int, bytes]) -> None:
        """Keep the suffixes whose gram occurs again; build their sorted distinct contexts."""
        again = np.zeros(len(self.distinct), bool)
        for r, i, j in _blocks(_range_of(self.distinct, self.ranges)):
            again[i:j] = np.unpackbits(np.frombuffer(bits[r], np.uint8))[: j - i]
        keep = again[self.which.ravel()]
        self.at, self.h = self.at[keep], self.h[keep]
        doc = np.searchsorted(self.offsets, self.at, side="right") - 1
        start, end = self.offsets[doc], self.offsets[doc + 1]
        n = len(self.at)
        rows = np.full((n, 4 + WIDTH + BACK), PAD, np.uint8)
        rows[:, :4] = _range_of(self.h, self.ranges).astype(">u4").view(np.uint8).reshape(n, 4)
        for i in range(0, n, 8192):
            p = self.at[i : i + 8192, None]
            q = p + np.arange(WIDTH)
            rows[i : i + 8192, 4 : 4 + WIDTH] = np.where(q < end[i : i + 8192, None], self.raw[np.minimum(q, len(self.raw) - 1)], PAD)
            q = p - 1 - np.arange(BACK)
            rows[i : i + 8192, 4 + WIDTH :] = np.where(q >= start[i : i + 8192, None], self.raw[np.maximum(q, 0)], PAD)
        if n:
            kind = np.dtype(f"S{rows.shape[1]}")
            _, first, inverse, count = np.unique(rows.view(kind).ravel(), return_index=True, return_inverse=True, return_counts=True)
            self.context, self.multi, self.inverse = rows[first], count > 1, inverse.ravel()
        else:
            self.context, self.multi, self.inverse = rows, np.zeros(0, bool), np.zeros(0, np.int64)
        self.context_range = self.context[:, :4].copy().view(">u4").ravel().astype(np.int64)

    def suffix_blocks(self):
        """Front-coded sorted runs by range."""
        for r, i, j in _blocks(self.context_range):
            yield r, front_code(self.context[i:j, 4:], self.multi[i:j])

    def removed(self, found: dict[int, bytes]) -> np.ndarray:
        """The mask of the removed bytes, from the least and greatest start before each context."""
        bounds = np.full((len(self.context), 2), NONE, np.uint8)
        for r, i, j in _blocks(self.context_range):
            bounds[i:j] = np.frombuffer(found[r], np.uint8).reshape(-1, 2)
        least, most = bounds[self.inverse].T.astype(np.int64) if len(self.at) else (np.zeros(0, np.int64),) * 2
        ok = least != NONE
        step = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(step, self.at[ok] - most[ok], 1)
        np.add.at(step, self.at[ok] - least[ok] + WIDTH, -1)
        return np.cumsum(step[:-1]) > 0


def front_code(rows: np.ndarray, multi: np.ndarray) -> bytes:
    """Sorted rows as common prefix lengths and what follows them."""
    n, width = rows.shape
    lcp = np.zeros(n, np.uint16)
    if n > 1:
        differs = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    rest = rows[np.arange(width) >= lcp[:, None]]
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(n).tobytes() + lcp.tobytes() + multi.astype(np.uint8).tobytes() + rest.tobytes())


def front_decode(blob: bytes, width: int = WIDTH + BACK) -> tuple[Iterator[tuple[bytes, int]], np.ndarray]:
    """Rows with their common prefix lengths, one by one, and the flags of all."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    lcp = np.frombuffer(data, np.uint16, n, 4)

    def rows() -> Iterator[tuple[bytes, int]]:
        at, last = 4 + 3 * n, b""
        for k in lcp.tolist():
            to = at + width - k
            last = last[:k] + data[at:to]
            yield last, k
            at = to

    return rows(), np.frombuffer(data, np.uint8, n, 4 + 2 * n) > 0


def _common(a: bytes, b: bytes, k: int) -> int:
    """Common prefix length of two rows that share their first k bytes."""
    n = len(a)
    while k < n:
        x, y = a[k : k + 32], b[k : k + 32]
        if x != y:
            d = int.from_bytes(x) ^ int.from_bytes(y)
            return k + len(x) - (d.bit_length() + 7) // 8
        k += 32
    return n


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int, bytes]]:
    """Loser tree over sorted runs of (row, common prefix with the row before); yields (prefix, run, row).

    Each stream's current row carries its common prefix length with the last row put out. Of two rows the one
    with the longer prefix is smaller; only on equal lengths are bytes compared, from there on. No stream holds
    more than its current row.
    """
    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - k)
    current: list[bytes | None] = [h[0] if h else None for h in heads]
    shared = [0 if h else -1 for h in heads]
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        ha, hb = shared[a], shared[b]
        if ha > hb:
            return a, b
        if ha < hb:
            return b, a
        if ha < 0:
            return a, b
        x, y = current[a], current[b]
        h = _common(x, y, ha)
        if h == len(x) or x[h] < y[h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if size > 1 else 0
    while shared[w] >= 0:
        yield shared[w], w, current[w]
        current[w], shared[w] = next(runs[w], (None, -1))
        node = (w + size) >> 1
        while node:
            other = loser[node]
            ha, hb = shared[w], shared[other]
            if ha < hb:
                loser[node], w = w, other
            elif ha == hb and ha >= 0:
                w, loser[node] = play(w, other)
            node >>= 1


def starts_before(rows: np.ndarray, prefix: np.ndarray, multi: np.ndarray) -> np.ndarray:
    """For sorted distinct contexts: least and greatest j whose 200-byte string (from j bytes back) occurs again."""
    n = len(rows)
    values, up, _ = _tables()
    ahead = (rows[:, :WIDTH] != PAD).sum(axis=1)
    behind = (rows[:, WIDTH:] != PAD).sum(axis=1)
    lcp = np.minimum(prefix, WIDTH)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(ahead[1:], ahead[:-1]))
    least, most = np.full(n, NONE, np.int64), np.full(n, -1, np.int64)
    own_least, own_most = np.maximum(0, WIDTH - ahead), np.minimum(behind, BACK)
    alone = multi & (own_least <= own_most)
    least[alone], most[alone] = own_least[alone], own_most[alone]
    left = np.zeros(n, np.uint64)
    for j in range(BACK + 1):
        if j:
            left = left + values[rows[:, WIDTH + j - 1]] * up[j]
        joins = lcp >= WIDTH - j
        joins[:1] = False
        near = joins.copy()
        near[:-1] |= joins[1:]
        at = np.flatnonzero(near & (behind >= j) & (ahead >= WIDTH - j))
        if not len(at):
            continue
        group = np.cumsum(~joins)[at].astype(np.uint64)
        key = mix64(left[at] + mix64(group))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k), bool)
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        hit = at[order[same]]
        least[hit] = np.minimum(least[hit], j)
        most[hit] = np.maximum(most[hit], j)
    least[most < 0] = NONE
    most[most < 0] = NONE
    return np.stack([least, most], axis=1).astype(np.uint8)


def _gram_answers(t: pa.Table) -> pa.Table:
    """For one range: which hashes occur again, one bit each, to every run."""
    runs, blobs, own = t.column("_run").to_pylist(), [], []
    for b in t.column("_data"):
        d = b.as_py()
        n = len(d) // 9
        blobs.append(np.frombuffer(d, np.uint64, n))
        own.append(np.frombuffer(d, np.uint8, n, 8 * n))
    every = np.concatenate(blobs)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    again = (counts[inverse.ravel()] > 1) | (np.concatenate(own) > 0)
    out, i, r = [], 0, t.column("_range")[0].as_py()
    for run, b in zip(runs, blobs, strict=True):
        out.append((run, 1, r, np.packbits(again[i : i + len(b)]).tobytes()))
        i += len(b)
    return _answers(out)


def _suffix_answers(t: pa.Table) -> pa.Table:
    """For one range: merge the runs, find the repeats, answer every run."""
    runs, rng = t.column("_run").to_pylist(), t.column("_range")[0].as_py()
    streams, flags = zip(*(front_decode(b.as_py()) for b in t.column("_data")), strict=True)
    width = WIDTH + BACK
    distinct, prefix, multi, owner, number = bytearray(), array("h"), bytearray(), array("i"), array("q")
    seen = [0] * len(runs)
    for h, w, row in merge(list(streams)):
        again = flags[w][seen[w]]
        seen[w] += 1
        if h == width and prefix:
            multi[-1] = 1
        else:
            distinct += row
            prefix.append(h)
            multi.append(bool(again))
        owner.append(w)
        number.append(len(prefix) - 1)
    rows = np.frombuffer(distinct, np.uint8).reshape(-1, width)
    found = np.empty((len(rows), 2), np.uint8)
    prefix_, multi_ = np.array(prefix, np.int64), np.frombuffer(multi, np.uint8) > 0
    # classes of equal grams are evaluated in slices of whole classes
    cuts = np.concatenate((np.flatnonzero(prefix_ < GRAM), [len(prefix_)]))
    a = 0
    while a < len(prefix_):
        b = int(cuts[max(np.searchsorted(cuts, a + 16384, side="right") - 1, np.searchsorted(cuts, a, side="right"))])
        found[a:b] = starts_before(rows[a:b], prefix_[a:b].copy(), multi_[a:b])
        a = b
    w, number = np.array(owner, np.int64), np.array(number, np.int64)
    order = np.argsort(w, kind="stable")  # a run's rows come out in its own order
    w, number = w[order], number[order]
    edges = np.searchsorted(w, np.arange(len(runs) + 1))
    out = _answers([(run, 2, rng, found[number[edges[k] : edges[k + 1]]].tobytes()) for k, run in enumerate(runs)])
    del streams, flags, distinct, rows, owner, w, number, order
    release()
    return out


def remove_repeats(docs: DataFrame, text: str = "text", keep_text: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 (and ``kept_text``) to every row of ``docs``.

    Texts are UTF-8 bytes, null is empty; matches stay within a text. ``docs`` needs doc_id; repeated ids are
    different texts and equal rows repeat each other. Columns of the new names are replaced, others pass through.
    ``kept_text`` is the rest of the text without characters of which a part was removed (null stays null).
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
    docs = docs.drop(*new, "_run")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_runs, ranges, tasks = max(1, -(-total // run_bytes)), max(6 * partitions(spark), total // RANGE_BYTES), max(partitions(spark), total // TASK_BYTES)
    dealt = docs.withColumn("_run", F.pmod(F.xxhash64("doc_id", text), F.lit(n_runs))).repartition(tasks, "_run")
    fields = [*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in new[:3]), *(T.StructField(c, T.StringType()) for c in new[3:])]

    def grams(t: pa.Table) -> pa.Table:
        run = t.column("_run")[0].as_py()
        out = _answers([(run, 0, r, d) for r, d in Run(t.column(text), ranges).gram_blocks()])
        release()
        return out

    def answers_of(t: pa.Table, kind: int) -> dict[int, bytes]:
        return {r: d for k, r, d in zip(t.column("_kind").to_pylist(), t.column("_range").to_pylist(), t.column("_data").to_pylist(), strict=True) if k == kind}

    def suffixes(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _answers([])
        run, x = t.column("_run")[0].as_py(), Run(t.column(text), ranges)
        x.keep_repeated(answers_of(back, 1))
        out = _answers([(run, 0, r, d) for r, d in x.suffix_blocks()])
        del x
        release()
        return out

    def apply(t: pa.Table, back: pa.Table) -> pa.Table:
        x = Run(t.column(text), ranges)
        x.keep_repeated(answers_of(back, 1))
        gone = x.removed(answers_of(back, 2))
        edges = np.concatenate((np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1), []))
        # a removed run that crosses into the next text starts anew there
        crossing = x.offsets[1:-1][(x.offsets[1:-1] > 0) & (x.offsets[1:-1] < len(gone))] if len(x.offsets) > 2 else np.zeros(0, np.int64)
        crossing = np.unique(crossing[gone[crossing] & gone[crossing - 1]]) if len(crossing) else crossing
        starts = np.sort(np.concatenate((edges, crossing)))
        spans = np.diff(np.searchsorted(starts, x.offsets))
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[x.offsets[1:]] - total[x.offsets[:-1]]
        sha, kept = [], []
        nulls = t.column(text).is_null().to_pylist()
        for k, (i, j) in enumerate(zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True)):
            part = x.raw[i:j]
            if removed[k]:
                part = part[~gone[i:j]]
            part = part.tobytes()
            sha.append(hashlib.sha256(part).hexdigest())
            if keep_text:
                kept.append(None if nulls[k] else part.decode("utf-8", "ignore") if removed[k] else part.decode())
        out = t.drop_columns(["_run"])
        for c, v in zip(new, (np.diff(x.offsets), removed, spans), strict=False):
            out = out.append_column(c, pa.array(v, pa.int64()))
        out = out.append_column("kept_sha256", pa.array(sha, pa.string()))
        return out.append_column("kept_text", pa.array(kept, pa.string())) if keep_text else out

    by_run = dealt.groupBy("_run")
    first = by_run.applyInArrow(grams, EXCHANGE).repartition(tasks, "_range").groupBy("_range").applyInArrow(_gram_answers, EXCHANGE)
    second = by_run.cogroup(first.groupBy("_run")).applyInArrow(suffixes, EXCHANGE).repartition(tasks, "_range").groupBy("_range").applyInArrow(_suffix_answers, EXCHANGE)
    return by_run.cogroup(first.unionByName(second).groupBy("_run")).applyInArrow(apply, T.StructType(fields))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("text")


#: The same over hexadecimal text, by grouping every 200-byte string.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, {2 * WIDTH})) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {WIDTH} + 1)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= last + {WIDTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island
    FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{WIDTH + 1}) AS last FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + {WIDTH} AS b FROM g GROUP BY doc_id, island),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
t AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept,
    count(*) AS n_spans, sum(b - a) AS n_removed FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
