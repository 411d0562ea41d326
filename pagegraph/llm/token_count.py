"""Token counts: greedy longest-match word pieces, counted without building them.

The vocabulary is a byte trie. Every node has a failure link and the number of pieces popped on the way along
it, both computed once, so a word's count is one walk over its bytes. Words repeat a lot: a bounded cache keeps
their counts per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
CACHE = 400_000
MARK = 0x100  #: edge label for "a word starts here", kept apart from the bytes


def byte_pieces(path: str = VOCAB) -> list[tuple[bytes, bool]]:
    """The pieces of a byte-level vocabulary file as (bytes, whether the piece starts a word)."""
    # The byte-level alphabet maps printable Latin-1 bytes to themselves and the others to U+0100 and on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    space = chr(256 + other.index(0x20))
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = []
    for piece in vocab:
        start = piece.startswith(space) and len(piece) > 1
        body = piece[1:] if start else piece
        if body and all(c in alphabet for c in body):
            out.append((bytes(alphabet[c] for c in body), start))
    return out


class PieceCounter:
    """Linear longest-match counter over a trie with failure links.

    A word is read as MARK followed by its bytes. From a node, the failure link leads to the node for what is
    left after popping the longest pieces that the node's string begins with; ``popped`` says how many those
    are. Single bytes are always pieces (a byte outside the vocabulary counts as one unknown piece), so every
    node has a link.
    """

    def __init__(self, pieces: list[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = [{}]
        up: list[tuple[int, int]] = [(0, 0)]
        ends: set[int] = set()
        for body, start in [*pieces, *((bytes([b]), False) for b in range(256))]:
            node = 0
            for c in ([MARK] if start else []) + list(body):
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    up.append((node, c))
                node = to
            ends.add(node)
        self.mark = self.next[0].get(MARK, 0)
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:  # breadth first: links of shorter strings are ready
            queue.extend(self.next[node].values())
            if node in ends:
                self.popped[node] = 1
            elif node != self.mark:  # the mark alone is dropped without a count
                above, c = up[node]
                at, n = self.fail[above], self.popped[above]
                while c not in self.next[at]:
                    at, n = self.fail[at], n + self.popped[at]
                self.fail[node], self.popped[node] = self.next[at][c], n

    def count(self, word: bytes) -> int:
        """Pieces of one word: every failure step pops at least one piece or the mark."""
        nxt, fail, popped = self.next, self.fail, self.popped
        node, total = self.mark, 0
        for c in word:
            to = nxt[node].get(c)
            while to is None:
                total += popped[node]
                node = fail[node]
                to = nxt[node].get(c)
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, vocab: str = VOCAB, text: str = "text", cache: int = CACHE) -> DataFrame:
    """Adds ``n_words`` and ``n_tokens`` (long) to ``docs``; a column of either name is replaced.

    Words are what ASCII white space separates; null and empty texts have 0 of both. Whole texts are read.
    The vocabulary (a file of bounded size) is read on the driver and sent with the task once per worker.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(byte_pieces(vocab))
    docs = docs.drop("n_words", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(broadcast.value)
        known: dict[bytes, int] = {}
        get = known.get
        for b in batches:
            words, tokens = [], []
            for t in b.column(text).to_pylist():
                ws = t.encode().split() if t else ()
                counts = list(map(get, ws))
                if None in counts:
                    for w in set(ws):
                        if w not in known:
                            if len(known) >= cache:
                                known.clear()
                            known[w] = counter.count(w)
                    counts = [get(w) if get(w) is not None else counter.count(w) for w in ws]
                words.append(len(ws))
                tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*b.schema.names, "n_words", "n_tokens"])

    return docs.mapInArrow(run, schema)


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
