"""N-gram Jaccard join: sets of five-word shingles at similarity 0.8 or more, by PartEnum signatures.

Sets in neighbouring size bands that are similar enough differ in at most k features (a quarter of the smaller
band's upper end). The feature domain is hashed into n1 first-level partitions; with n1 > k / 2 some partition
sees at most one difference, so of its three second-level parts two agree: their union's hash is a signature,
and each set enumerates all of them. Some details keep candidates few and results exact:

- equal sets are one node (the node id is a hash of the set), so copies cost nothing after the first step;
- a list of frequent features (of bounded length; any list would be right) keeps shared passages from making
  candidates. Dropping features never adds differences, so sets with more than k other ("rare") features sign by
  these alone. Two sets of which one has no more than k of them are still found: if both have over k / 2, they
  share a rare feature, and each is a signature of its own; else one has at most k / 2 (a "core" set, nearly all
  frequent), and the two sign by all features, where only buckets with a core set count;
- signatures over no features count only for sets that have too many of them to be sure of another one;
- within a signature's bucket every node is compared with the first (core) one. Where that leaves the bucket
  unconnected, its other pairs that might join two components are compared by sketches inside a task, and those
  that pass are compared exactly. Nothing else leaves a bucket, however large a group of copies is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, partitions, table, text_buffers
from .components import components

SHINGLE = 5
NUM, DEN = 4, 5  #: similarity of 4/5
RUN_BYTES = 4 << 20
COUNT_BYTES = 16 << 20  #: features that occur twice in a run of so much text are counted as frequent
SLAB = 1 << 19
FREQUENT_AT_MOST = 4_000_000
SKETCH = 256
TILE = 2048
LOT = 4096  #: members of buckets with the same first node that one group compares
RANGE_BYTES, TASK_BYTES = 16 << 20, 64 << 20  #: text whose signatures meet in one range, and in one task
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26  #: of the filter of nodes in pairs
U = np.uint64
_M = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _M, U), np.full(n, pow(_M, -1, 1 << 64), U)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_POWERS: list = []


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) and, per text, where its words begin (one more at the end)."""
    hashes, at, i, n = [], [np.zeros(1, np.int64)], 0, len(offsets) - 1
    found = 0
    while i < n:  # texts go through in slabs: what a slab takes besides stays small
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, side="right")) - 1)
        h, starts = _slab_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append(h)
        at.append(starts[1:] + found)
        found += len(h)
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, U), np.concatenate(at)


def _slab_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] |= solid[inner]
    starts = np.flatnonzero(first)
    last[:-1] &= ~solid[1:]
    last[inner - 1] |= solid[inner - 1]
    ends = np.flatnonzero(last) + 1
    if not _POWERS or len(_POWERS[0]) < len(raw):
        _POWERS[:] = _powers(max(len(raw), SLAB))
    up, down = _POWERS
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    return h, np.searchsorted(starts, offsets)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end (sorted within a text) and their offsets."""
    h, at = word_hashes(*text_buffers(texts))
    n = len(h)
    s = np.zeros(n, U)
    for i in range(SHINGLE):
        s[: max(0, n - i)] += mix64(h[i:] + U(i + 1))
    s = mix64(s)
    out, offsets = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            u = np.unique(s[a : b - SHINGLE + 1])
        elif b > a:
            u = mix64(mix64(h[a:b] + np.arange(1, b - a + 1, dtype=U)).sum(dtype=U, keepdims=True) + U(b - a))
        else:
            u = s[:0]
        out.append(u)
        offsets.append(offsets[-1] + len(u))
    return (np.concatenate(out) if out else s[:0]), np.array(offsets, np.int64)


def node_ids(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id per set (0 for the empty set)."""
    total = np.zeros(len(elements) + 1, U)
    np.cumsum(mix64(elements ^ U(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(offsets)
    ids = mix64(total[offsets[1:]] - total[offsets[:-1]] + n.astype(U))
    ids[n == 0] = 0
    return ids


def bands(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size bands up to ``most``, and their upper ends; a set and a larger similar one are in the same or neighbouring bands."""
    lo, hi = [1], [DEN // NUM]
    while hi[-1] < most:
        lo.append(hi[-1] + 1)
        hi.append(lo[-1] * DEN // NUM)
    return np.array(lo), np.array(hi)


def signatures(elements: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of all sets as (48-bit signature, set number, whether the set counts as core there)."""
    sizes = np.diff(offsets)
    if not len(elements):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    lo, hi = bands(int(sizes.max()))
    band = np.searchsorted(lo, np.maximum(sizes, 1), side="right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(elements), bool)
    if len(frequent):
        i = np.searchsorted(frequent, elements)
        rare = frequent[np.minimum(i, len(frequent) - 1)] != elements
    n_rare = np.bincount(owner[rare], minlength=len(sizes))
    out, who, core = [], [], []

    def put(sig: np.ndarray, doc: np.ndarray, is_core: np.ndarray) -> None:
        out.append(mix64(sig) >> U(16))
        who.append(doc)
        core.append(is_core)

    for step in (0, 1):  # the instance of the own band, and of the band below
        instance = band - step
        k = hi[np.maximum(instance, 0)] * (DEN - NUM) // NUM
        usable = (sizes > 0) & (instance >= 0) & (k > 0)  # sets that may not differ at all are one node
        tag = instance.astype(U) * U(4)
        single = usable & (2 * n_rare > k) & (n_rare <= 2 * k)
        use = single[owner] & rare
        if use.any():
            put(elements[use] + mix64(tag + U(3))[owner[use]], owner[use], np.ones(int(use.sum()), bool))
        for mode, wants in ((0, n_rare > k), (1, 2 * n_rare <= 3 * k)):
            chosen = usable & wants
            if not chosen.any():
                continue
            half = k // 2
            n1 = np.where(chosen, half + 1 + np.where(k >= 8, (half * 12 + 99) // 100 + 1, 0), 0)
            slot0 = np.concatenate(([0], np.cumsum(3 * n1)))
            use = chosen[owner] & (rare if mode == 0 else True)
            e, o = elements[use], owner[use]
            x = mix64(e + U(0x632BE59BD9B4E019) * (tag[o] + U(mode + 1)))
            part = ((x >> U(40)) * n1[o].astype(U) >> U(24)).astype(np.int64)
            sub = ((x & U(0xFFFFFF)) * U(3) >> U(24)).astype(np.int64)
            slot = slot0[o] + 3 * part + sub
            sums = np.zeros(slot0[-1], U)
            np.add.at(sums, slot, mix64(x))
            count = np.bincount(slot, minlength=slot0[-1])
            sums, count = sums.reshape(-1, 3), count.reshape(-1, 3)
            sums, count = sums.sum(axis=1, keepdims=True, dtype=U) - sums, count.sum(axis=1, keepdims=True) - count
            doc = np.repeat(np.arange(len(sizes)), n1)
            weak = np.bincount(doc[(count == 0).any(axis=1)], minlength=len(sizes))
            odd = weak >= n1 - half
            number = np.arange(len(doc)) - (slot0[:-1] // 3)[doc]
            name = ((number[:, None] * 3 + np.arange(3)).astype(U) << U(12)) + (tag[doc] + U(mode))[:, None] + U(1)
            keep = (count > 0) | odd[doc][:, None]
            own = np.broadcast_to(doc[:, None], keep.shape)[keep]
            put((sums + mix64(name * U(0x9E3779B97F4A7C15)))[keep], own, np.ones(len(own), bool) if mode == 0 else 2 * n_rare[own] <= k[own])
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(who), np.concatenate(core)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64), pa.int64())


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], run_bytes: int = RUN_BYTES) -> Iterator[pa.Table]:
    """Batches gathered into runs of about ``run_bytes`` (large ones are cut by rows)."""
    held, size = [], 0
    for b in batches:
        rows = max(1, b.num_rows * run_bytes // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            held.append(b.slice(i, rows))
            size += held[-1].get_total_buffer_size() if b.num_rows <= rows else run_bytes
            if size >= run_bytes:
                yield pa.Table.from_batches(held).select(columns)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).select(columns)


def _distinct_sets(t: pa.Table, text: str):
    elements, offsets = shingle_sets(t.column(text))
    ids = node_ids(elements, offsets)
    _, first = np.unique(ids, return_index=True)
    first = first[np.diff(offsets)[first] > 0]
    sizes = np.diff(offsets)[first]
    pick = np.concatenate([elements[offsets[i] : offsets[i + 1]] for i in first]) if len(first) else elements[:0]
    return ids[first], pick, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Sorted integers as differences, by byte planes."""
    d = np.diff(x, prepend=x[:1] * 0)
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel(), dtype=U)


def _buckets(t: pa.Table) -> pa.Table:
    """One signature range: stars (a, b) and, for buckets of three nodes or more, their members.

    ``members`` holds the number of core nodes and then all nodes, core ones first.
    """
    sig, node = [], []
    for blob in t.column("_data"):
        d = zstandard.ZstdDecompressor().decompress(blob.as_py())
        n, m = np.frombuffer(d, np.int64, 2)
        sig.append(_unpack(d[16 : 16 + 8 * n], n))
        names = np.frombuffer(d, U, m, 16 + 8 * n)
        local = np.frombuffer(d, np.uint32, n, 16 + 8 * n + 8 * m)
        node.append(np.stack([names[local >> 1], (local & 1).astype(U)], axis=1))
    sig, node = np.concatenate(sig), np.concatenate(node)
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    same = np.zeros(len(sig) + 1, bool)
    same[1:-1] = sig[1:] == sig[:-1]
    keep = same[:-1] | same[1:]
    sig, node, late = sig[keep], node[keep, 0], node[keep, 1] == 0
    order = np.lexsort((node, late, sig))
    sig, node, late = sig[order], node[order], late[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node, late = sig[new], node[new], late[new]
    none = np.zeros(0, U)
    if not len(sig):
        return pa.table({"a": _as_long(none), "b": _as_long(none), "members": pa.array([], pa.binary())})
    edge = np.concatenate(([0], np.flatnonzero(np.diff(sig)) + 1, [len(sig)]))
    lengths = np.diff(edge)
    begin = np.repeat(edge[:-1], lengths)
    use = ~late[begin] & (np.arange(len(sig)) != begin)
    pairs = np.unique(np.stack([node[begin], node], axis=1)[use], axis=0)
    lists: dict[bytes, int] = {}
    for i in np.flatnonzero((lengths >= 3) & ~late[edge[:-1]]):
        p, q = edge[i], edge[i + 1]
        lists.setdefault(np.uint64((~late[p:q]).sum()).tobytes() + node[p:q].tobytes(), int(node[p]))
    a = np.concatenate([pairs[:, 0], np.array(list(lists.values()), U)])
    b = np.concatenate([pairs[:, 1], np.zeros(len(lists), U)])
    return pa.table({"a": _as_long(a), "b": _as_long(b), "members": pa.array([None] * len(pairs) + list(lists), pa.binary())})


def _sketch(elements: np.ndarray) -> bytes:
    """How many elements fall into each of SKETCH buckets; sets differ in at least as many elements as their sketches do."""
    return np.minimum(np.bincount((elements & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the differences of sketches: no more than the number of elements in which the sets differ."""
    return (np.maximum(x, y) - np.minimum(x, y)).sum(axis=-1, dtype=np.int64)


def _filter_pairs(test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([test(*(v.as_py() for v in row)) for row in zip(*batch.columns[2:], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _may_be(n: int, m: int, x: bytes, y: bytes) -> bool:
    if NUM * max(n, m) > DEN * min(n, m):
        return False
    return (DEN + NUM) * int(_apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))) <= (DEN - NUM) * (n + m)


def _similar(n: int, m: int, x: bytes, y: bytes) -> bool:
    a, b = _unpack_set(x, n), _unpack_set(y, m)
    i = np.minimum(np.searchsorted(b, a), m - 1)
    shared = int((b[i] == a).sum())
    return DEN * shared >= NUM * (n + m - shared)


def _pack_set(elements: np.ndarray) -> bytes:
    """Sorted 64-bit hashes."""
    return zstandard.ZstdCompressor(level=1).compress(_pack(elements))


def _unpack_set(data: bytes, n: int) -> np.ndarray:
    return _unpack(zstandard.ZstdDecompressor().decompress(data), n)


def _open_pairs(t: pa.Table) -> pa.Table:
    """Pairs of some buckets (or of two tiles of them) in different components, one of them core, that sizes and sketches allow.

    Buckets with the same first node share most of their pairs: they come together, and a pair leaves once.
    """
    bucket, nodes, roots, sizes, cores, seconds = (t.column(c).to_numpy() for c in ("bucket", "node", "root", "n", "core", "second"))
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), SKETCH)
    same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    order = np.argsort(bucket, kind="stable")
    found = np.zeros((0, 2), np.int64)
    held: list[np.ndarray] = []
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        node, root, n, core, h = nodes[rows], roots[rows], sizes[rows], cores[rows], sketches[rows]
        second = seconds[rows]
        own, other = (np.arange(len(n)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        for i in own:
            o = other[other > i] if same else other
            o = o[(root[o] != root[i]) & (core[o] | core[i]) & (NUM * np.maximum(n[o], n[i]) <= DEN * np.minimum(n[o], n[i]))]
            if len(o):
                o = o[(DEN + NUM) * _apart(h[o], h[i]) <= (DEN - NUM) * (n[o] + n[i])]
                held.append(np.stack([np.minimum(node[o], node[i]), np.maximum(node[o], node[i])], axis=1))
        if sum(map(len, held)) > 500_000:
            found, held = np.unique(np.concatenate([found, *held]), axis=0), []
    found = np.unique(np.concatenate([found, *held]), axis=0)
    return pa.table({"a": pa.array(found[:, 0].copy(), pa.int64()), "b": pa.array(found[:, 1].copy(), pa.int64())})


def _verify(pairs: DataFrame, sets: DataFrame, steps=(("n", "sketch"), ("n", "data"))) -> DataFrame:
    """The pairs (a, b) whose sets are similar: sizes and sketches rule out most others before sets are sent."""
    for columns in steps:
        left = sets.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
        right = sets.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
        both = pairs.join(left, "a").join(right, "b")
        test = _may_be if "sketch" in columns else _similar
        pairs = both.select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab")).mapInArrow(_filter_pairs(test), "a long, b long")
    return pairs


def _members(nodes: DataFrame) -> tuple[bytes, int]:
    """A filter with the nodes' bits set, and its number of bits: 16 a node, at most MOST_BITS (a full filter lets more sets through, none less)."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * nodes.count()):
        bits *= 2
    place = F.col("node").bitwiseAND(bits - 1)
    words = nodes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return zstandard.compress(out.astype("<i8").tobytes(), 1), bits


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Null, empty and blank texts have the empty set and link with nothing; a text of fewer than five words has
    one shingle, all of it; texts are read whole, however long. Rows that repeat a doc_id (or have none) are texts of
    their own, joined under that id's component only if they are similar. Equal sets always link, and a tie at the
    threshold links too. Shingles are compared as 64-bit hashes. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", F.col(text).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    enough = max(16, total // 6 // FREQUENT_AT_MOST)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["doc_id", "text"], COUNT_BYTES):
            elements, offsets = shingle_sets(t.column("text"))
            ids = node_ids(elements, offsets)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(np.diff(offsets), pa.int64()), _as_long(ids), pa.nulls(len(ids), pa.int64())], names=["doc_id", "n_shingles", "node", "feature"])
            _, first = np.unique(ids, return_index=True)
            chosen = np.zeros(len(ids), bool)
            chosen[first] = True
            u, c = np.unique(elements[np.repeat(chosen, np.diff(offsets))], return_counts=True)
            often = c >= max(2, enough * int(offsets[-1]) * 3 // max(1, total))
            u, c = u[often], c[often]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(u), t.schema.field("doc_id").type), pa.array(c, pa.int64()), pa.nulls(len(u), pa.int64()), _as_long(u)], names=["doc_id", "n_shingles", "node", "feature"])

    doc_type = dict(docs.dtypes)["doc_id"]
    scanned = cut(docs.mapInArrow(scan, f"doc_id {doc_type}, n_shingles long, node long, feature long"))
    rows = scanned.where("feature is null").select("doc_id", "n_shingles", "node")
    # at most (features in all) / enough entries, so a few million longs at any size of input
    often = scanned.where("feature is not null").groupBy("feature").agg(F.sum("n_shingles").alias("c")).where(F.col("c") >= enough).select("feature").toPandas()
    frequent = sc.broadcast(pickle.dumps(np.sort(often["feature"].to_numpy(np.int64).view(U))))
    ranges, tasks = max(2 * partitions(spark), total // RANGE_BYTES), max(partitions(spark), total // TASK_BYTES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pickle.loads(frequent.value)
        packer = zstandard.ZstdCompressor(level=1)
        for t in _runs(batches, ["text"]):
            ids, elements, offsets = _distinct_sets(t, "text")
            sig, who, core = signatures(elements, offsets, common)
            order = np.argsort(sig)
            sig, who, core = sig[order], who[order], core[order]
            cuts = np.searchsorted(sig, (np.arange(1, ranges, dtype=U) * U((1 << 48) // ranges)))
            out_r, out_d = [], []
            for r, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(sig)], strict=True)):
                if j > i:
                    names, local = np.unique(who[i:j], return_inverse=True)
                    out_r.append(r)
                    out_d.append(packer.compress(np.array([j - i, len(names)], np.int64).tobytes() + _pack(sig[i:j]) + ids[names].tobytes() + (local.ravel().astype(np.uint32) << 1 | core[i:j]).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out_r, pa.int64()), pa.array(out_d, pa.binary())], names=["_range", "_data"])

    found = docs.select("text").mapInArrow(emit, "_range long, _data binary").repartition(tasks, "_range").groupBy("_range").applyInArrow(_buckets, "a long, b long, members binary")
    found = cut(found)
    stars = found.where("members is null").select("a", "b").distinct()
    involved = cut(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    filled, size = _members(involved)
    wanted = sc.broadcast(filled)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.decompress(wanted.value), np.uint8)
        for t in _runs(batches, ["text"]):
            ids, elements, offsets = _distinct_sets(t, "text")
            x = ids & U(size - 1)
            own = np.flatnonzero(bits[(x >> U(3)).astype(np.int64)] >> (x & U(7)).astype(np.uint8) & 1)
            parts = [elements[offsets[i] : offsets[i + 1]] for i in own]
            columns = [_as_long(ids[own]), pa.array([len(e) for e in parts], pa.int64()), pa.array(map(_sketch, parts), pa.binary()), pa.array(map(_pack_set, parts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "data"])

    sets = docs.select("text").mapInArrow(sets_of, "node long, n long, sketch binary, data binary")
    sets = cut(sets.join(involved, "node", "left_semi").dropDuplicates(["node"]))
    links = cut(_verify(stars, sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                m = np.frombuffer(members.as_py(), U)
                n, pos = len(m) - 1, np.arange(len(m) - 1)
                name = mix64(m[1:] + pos.astype(U)).sum(dtype=U, keepdims=True) + m[0]
                yield pa.RecordBatch.from_arrays([_as_long(np.repeat(name, n)), pa.array(pos // TILE, pa.int32()), pa.array(np.full(n, -(-n // TILE)), pa.int32()), pa.array(pos < int(m[0]), pa.bool_()), _as_long(m[1:]), _as_long(np.repeat(m[1:2], n))], names=["bucket", "t", "tiles", "core", "node", "leader"])

    # What a bucket's first node left unconnected is compared within the bucket, by sketches; large buckets go in
    # pairs of tiles. Only pairs that may be similar and would join two components leave a task.
    left = found.where("members is not null").select("members").mapInArrow(spread, "bucket long, t int, tiles int, core boolean, node long, leader long")
    left = left.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = left.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    left = cut(left.join(still, "bucket", "left_semi"))
    lots = cut(left.groupBy("leader").agg(F.ceil(F.count("*") / LOT).alias("lots")).where("lots > 1"))  # few, so that a hot leader's members can split
    left = left.join(lots, "leader", "left").withColumn("lot", F.pmod("bucket", F.coalesce("lots", F.lit(1)))).join(sets.select("node", "n", "sketch"), "node")
    left = left.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.select("leader", "lot", "bucket", F.least("t", "s").alias("i"), F.greatest("t", "s").alias("j"), (F.col("t") > F.col("s")).alias("second"), "core", "node", "root", "n", "sketch")
    pairs = left.groupBy("leader", "lot", "i", "j").applyInArrow(_open_pairs, "a long, b long").distinct()
    roots = components(links.unionByName(_verify(pairs, sets, (("n", "data"),))))
    labelled = rows.join(roots, "node", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))
    least = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
