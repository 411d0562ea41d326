"""Benchmark decontamination with Aho-Corasick automata over normalised benchmark windows.

Texts are normalised to lower-cased words, and the automaton reads word numbers, not letters: every word of the
benchmark has a sign of two or three digits, so a window of ten words has some twenty states. Each text is scanned once per automaton (one,
unless the benchmark outgrows ``states``), and match ends are word numbers, which map back to byte offsets of the
original text.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

WINDOW = 10
BASE = 256
STATES = 8_000_000  #: of an automaton, at most (about 0.3 GB with its windows)
MOST_BYTES = 1 << 28
SPOOL_BYTES = 64 << 20
# Every byte that is no word byte becomes a space, A-Z become a-z; bytes above 0x7F belong to words.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The item's windows: ``width`` consecutive words, or all of a shorter item."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _sign(k: int, digits: int) -> str:
    """Word number k as digits; every place has letters of its own, so that no match begins inside a word."""
    return "".join(chr(BASE * (i + 1) + k // BASE**i % BASE) for i in range(digits))


class Shard:
    """An Aho-Corasick automaton over word numbers: a window is a path of some letters a word, whatever its words' lengths.

    Numbers are written with few different letters because a state is searched for its letters one by one.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        import ahocorasick

        owners: dict[tuple[bytes, ...], set] = {}
        for item_id, text in items:
            for w in windows_of(normal_words(text), width):
                owners.setdefault(w, set()).add(item_id)
        words = {w: k for k, w in enumerate(dict.fromkeys(w for window in owners for w in window))}
        self.digits = next(n for n in range(1, 9) if BASE**n >= len(words))
        self.signs = {w: _sign(k, self.digits) for w, k in words.items()}
        self.unknown = "\0" * self.digits
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word("".join([self.signs[w] for w in window]), (len(window), tuple(sorted(ids, key=str))))
        if owners:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple]]:
        """(number of the window's last word, its number of words, item ids) of every occurrence."""
        if self.signs:
            sign, unknown = self.signs.get, self.unknown
            for end, (n, ids) in self.automaton.iter("".join([sign(w, unknown) for w in words])):
                yield end // self.digits, n, ids


def build(items: list[tuple[object, str | None]], width: int = WINDOW) -> Shard:
    return Shard(items, width)


def scan(text: str | None, shards: list[Shard]) -> tuple[int, np.ndarray, set]:
    """Number of words, the hit mask over words, and the ids of the items with windows in the text."""
    words = normal_words(text)
    step, found = None, set()
    for shard in shards:
        for last, n, ids in shard.matches(words):
            if step is None:
                step = np.zeros(len(words) + 1, np.int32)
            step[last - n + 1] += 1
            step[last + 1] -= 1
            found.update(ids)
    return len(words), np.cumsum(step[:-1]) > 0 if step is not None else np.zeros(len(words), bool), found


def word_spans(text: str) -> list[tuple[int, int]]:
    """Byte offsets of the words in the original text."""
    raw = np.frombuffer(b" " + text.encode().translate(NORMAL) + b" ", np.uint8) != 0x20
    edge = np.flatnonzero(raw[1:] != raw[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def load_shards(benchmark: DataFrame, states: int = STATES, width: int = WINDOW, most_bytes: int = MOST_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in shards whose automata have at most ``states`` states (or that of one item), streamed to the driver one by one.

    A benchmark is a stated query set; its size is measured while it is read, and beyond ``most_bytes`` of text it is
    refused (it can be run in parts). Duplicate and null items are kept.
    """
    shard, size, total = [], 0, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        total += len((row.text or "").encode())
        if total > most_bytes:
            raise ValueError(f"more than {most_bytes} bytes of benchmark text: decontaminate against parts of it")
        n = 3 * width * len(normal_words(row.text))
        if shard and (size + n > states):
            yield shard
            shard, size = [], 0
        shard.append((row.item_id, row.text))
        size += n
    if shard:
        yield shard


def _spools(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches gathered to about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(text).nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, states: int = STATES, text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and spans to every row of ``docs``.

    ``spans`` are byte offsets (start, end) of hit runs in the original text. Null or empty texts have no words
    and are clean; null items have no windows; an empty benchmark finds nothing. Items are told apart by id: rows that
    repeat one are parts of one item. Texts are scanned whole, repeated rows each. Columns of the new names are
    replaced, others pass through; an empty table gives an empty result. One automaton serves (the text is scanned
    once) unless the benchmark has more than ``states`` states: then a worker holds one shard at a time and goes
    through SPOOL_BYTES of text with it.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(pickle.dumps(s)) for s in load_shards(benchmark, states, width)]
    long, spans_type = T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    new = {"n_words": long, "n_hit": long, "n_items": long, "items_sha256": T.StringType(), "contaminated": T.BooleanType(), "spans": spans_type}
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, kind) for c, kind in new.items())])

    def answer(b: pa.RecordBatch, found: list[tuple[int, np.ndarray, set]]) -> pa.RecordBatch:
        n_words, n_hit, n_items, sha, spans = [], [], [], [], []
        for t, (n, mask, items) in zip(b.column(text), found, strict=True):
            n_words.append(n)
            n_hit.append(int(mask.sum()))
            n_items.append(len(items))
            sha.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
            runs = []
            if items:
                at = word_spans(t.as_py())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                runs = [{"start": at[i][0], "end": at[j - 1][1]} for i, j in zip(edge[::2], edge[1::2], strict=True)]
            spans.append(runs)
        own = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(sent) < 2:
            shards = [Shard(pickle.loads(s.value), width) for s in sent]
            for b in batches:
                yield answer(b, [scan(t.as_py(), shards) for t in b.column(text)])
            return
        for held in _spools(batches, text, SPOOL_BYTES):
            found: list[list] = [[None] * b.num_rows for b in held]
            for s in sent:
                shard = Shard(pickle.loads(s.value), width)
                for own, b in zip(found, held, strict=True):
                    for i, t in enumerate(b.column(text)):
                        n, mask, items = scan(t.as_py(), [shard])
                        if own[i] is None:
                            own[i] = n, mask if items else None, items
                        elif items:
                            own[i] = n, mask if own[i][1] is None else own[i][1] | mask, own[i][2] | items
                del shard
            for own, b in zip(found, held, strict=True):
                yield answer(b, [(n, np.zeros(n, bool) if mask is None else mask, items) for n, mask, items in own])

    return docs.mapInArrow(run, schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text", "spans")


_WORDS = "list_filter(string_split(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
