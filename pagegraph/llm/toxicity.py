"""Toxicity: subsequence string kernel, Nystroem landmarks, and a linear support vector machine.

Words. A string's features are the triples of its signs in order, each weighted by DECAY to the power of its span, so
inserted characters and gaps cost some of a match's weight and not all of it. The kernel of two words is the product
of these features over the weight that words of their lengths have (it divides by a function of each word alone, so it
stays a kernel), to the power POWER, which is one again and keeps what is merely alike small. There is no floor.

Sentences. A text is read in stretches of SPAN words. A stretch is the bag of its words and of its windows of two or
three neighbouring words read as one (split words); the kernel of two bags is the sum over their pairs. Landmarks are
bags of one word, and the Nystroem map K^(-1/2) of the landmarks' own kernel makes a stretch's kernel values with them
the features of a linear machine with squared hinge loss. A text has the margin of its worst stretch. As labels are
known for texts only, the machine is fitted on the worst stretch of each text by its last fit, some times over, and a
logistic fit on folds turns margins into probabilities.

Landmarks are found by kernel matching pursuit: of the words that training texts of label 1 share, each step takes the
one whose kernel values with the texts go best with what the machine on the landmarks so far gets wrong. The machine
also sees copies of texts whose longer words hold an inserted letter.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LANDMARKS, CANDIDATES, SAMPLE = 64, 1536, 6000
DECAY, REACH, POWER = 0.75, 6, 3  #: triples span at most REACH signs
SPAN = 16  #: words of a stretch
JOINED = 12  #: signs that neighbouring words read as one may have
PIECE, WHOLE = 6, 24  #: runs of more than WHOLE letters (scripts without spaces) are read in pieces
CHUNK = 2048  #: words that are read at once; their values with the landmarks stay in a core's cache
WORDS, WINDOWS, BIT = 1 << 19, 1 << 21, 21  #: words and windows whose values a task keeps before it begins anew; bits of a word's number
ROUNDS = 4
NOISE = 0.055  #: over the root of the number of texts of label 1: a landmark's share in what is still wrong, at least
CUT = 0.3
BITS = 6
START = 0  #: the sign before every word, so that beginnings weigh more than what merely occurs inside
_SPACE, _DROP = 255, 254
#: Offsets of a triple's second and third sign, and its weight.
_TRIPLES = [(i, j, DECAY ** (j + 1)) for j in range(2, REACH) for i in range(1, j)]


def _other(code: int) -> int:
    """One of 37 signs for letters beyond a-z."""
    return 27 + (code * 0x9E3779B1 >> 7) % 37


def _signs() -> np.ndarray:
    """A sign per code point of the basic plane: a-z for both cases, letters and marks of other scripts case aside."""
    out = np.full(0x10000, _DROP, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isspace():
            out[code] = _SPACE
        elif c.isalpha() or (code > 0x7F and ("a" + c).isidentifier() and not c.isdigit()):
            low = ord(c.lower()[0])
            out[code] = low - 96 if 97 <= low <= 122 else _other(low)
    return out


_TABLE: list[np.ndarray] = []


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signs of all words end to end, the words' lengths, and the texts they are from.

    Letters spelled apart (``i d i o t``, by any blanks and symbols) are one word; very long words are cut in pieces.
    """
    if not _TABLE:
        _TABLE.append(_signs())
    raw = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    sign = _TABLE[0][np.minimum(raw, 0xFFFF)]
    far = np.flatnonzero(raw > 0xFFFF)
    sign[far] = [_other(int(c)) for c in raw[far]]
    blanks = np.cumsum(sign == _SPACE)
    on = np.flatnonzero(sign < _DROP)
    raw, text, blanks = sign[on].astype(np.int64), text[on], blanks[on]
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = (blanks[1:] != blanks[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, n))
    single = length == 1
    if single.any():  # runs of three words of one letter or more
        own = text[at]
        new = np.ones(len(at), bool)
        new[1:] = ~(single[1:] & single[:-1] & (own[1:] == own[:-1]))
        run = np.cumsum(new) - 1
        spelled = single & (np.bincount(run)[run] >= 3) & ~new
        first[at[spelled]] = False
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, n))
    if (length > WHOLE).any():
        place = np.arange(n) - np.repeat(at, length)
        first |= np.repeat(length > WHOLE, length) & (place % PIECE == 0)
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, n))
    return raw, length, text[at]


def distinct(raw: np.ndarray, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of those that ``raw`` holds end to end, and for each word its place among them."""
    ends = np.concatenate(([0], np.cumsum(length)))
    found = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(raw.astype(np.uint8))]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def triples(word: np.ndarray) -> dict[int, float]:
    """Weights of a word's triples of signs (the explicit kernel features)."""
    c, out = [START, *(int(x) for x in word)], {}
    n = len(c)
    for a in range(n - 2):
        for i, j, w in _TRIPLES:
            if a + j < n:
                code = c[a] << 2 * BITS | c[a + i] << BITS | c[a + j]
                out[code] = out.get(code, 0.0) + w
    return out


def _weight(length: np.ndarray) -> np.ndarray:
    """The weight of words of so many signs, if all their triples differ."""
    return np.sqrt(np.maximum(sum(w * w * np.maximum(length + 1 - j, 0) for _, j, w in _TRIPLES), 1e-12))


def _power(x: np.ndarray) -> np.ndarray:
    """``x`` to the power POWER, by products: they take a fraction of the time of ``**``."""
    out = x.copy()
    for _ in range(POWER - 1):
        out *= x
    return out


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` ascending numbers from each of ``first``, end to end."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Kernel:
    """Kernel values with a fixed list of landmarks (words as arrays of signs)."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        words = [np.frombuffer(m, np.uint8) for m in landmarks]
        own = [triples(w) for w in words]
        scale = _weight(np.array([len(w) for w in words], np.int64)) if words else np.zeros(0)
        held: dict[int, list[tuple[int, float]]] = {}
        for k, (t, q) in enumerate(zip(own, scale, strict=True)):
            for c, w in t.items():
                held.setdefault(c, []).append((k, w / q))
        #: Per code the place of its (landmark, weight) entries and their number.
        self.first, self.count = np.zeros(1 << 3 * BITS, np.int64), np.zeros(1 << 3 * BITS, np.int64)
        for c, entries in held.items():
            self.count[c] = len(entries)
        self.first[1:] = np.cumsum(self.count)[:-1]
        self.held = self.count > 0  # small enough to stay in a core's cache
        entries = [e for c in sorted(held) for e in held[c]]
        self.landmark, self.weight = np.array([k for k, _ in entries], np.int64), np.array([w for _, w in entries], float)
        #: The same once for each span from 3 to REACH, the weights times the span's.
        self.landmarks_by_span = np.tile(self.landmark, REACH - 2)
        self.weights_by_span = np.concatenate([DECAY ** (j + 1) * self.weight for j in range(2, REACH)])

    def gram(self) -> np.ndarray:
        words = [np.frombuffer(m, np.uint8).astype(np.int64) for m in self.landmarks]
        return self.values(np.concatenate(words), np.array([len(w) for w in words]), np.arange(len(words)), 1)

    def values(self, raw: np.ndarray, length: np.ndarray, text: np.ndarray, most: int = 3) -> np.ndarray:
        """Per word the sum of the kernel values of it and of the windows of up to ``most`` words of its text that begin with it."""
        out, n, start = self._alone(raw, length), len(length), np.cumsum(length) - length
        for d in range(1, min(most, n)):
            joined = sum(length[k : n - d + k] for k in range(d + 1))
            at = np.flatnonzero((text[: n - d] == text[d:]) & (joined <= JOINED))
            out[at] += self._alone(raw[spread(start[at], joined[at])], joined[at])
        return out

    def _alone(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``values`` of words by themselves: words of one length are the columns of a table, whose rows give a triple of all of them at once."""
        out, start = np.zeros((len(length), len(self.landmarks))), np.cumsum(length) - length
        for size in np.flatnonzero(np.bincount(length)).tolist():
            at = np.flatnonzero(length == size)
            signs = np.full((size + 1, len(at)), START, np.int64)
            signs[1:] = raw[start[at] + np.arange(size)[:, None]]
            first, second, column = signs << 2 * BITS, signs << BITS, np.tile(np.arange(len(at)) * len(self.landmarks), size)
            entries, keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, _ in _TRIPLES:
                if j <= size:
                    code = (first[: size + 1 - j] | second[i : size + 1 - j + i] | signs[j:]).ravel()
                    hit = np.flatnonzero(self.held[code])
                    code = code[hit]
                    entries.append(self.first[code] + (j - 2) * len(self.landmark))
                    keys.append(column[hit])
                    counts.append(self.count[code])
            count = np.concatenate(counts)
            entry = spread(np.concatenate(entries), count)
            key = np.repeat(np.concatenate(keys), count) + self.landmarks_by_span[entry]
            value = np.bincount(key, self.weights_by_span[entry], len(at) * len(self.landmarks)).reshape(len(at), -1)
            out[at] = _power(value / _weight(np.array(size)))
        return out

    def stretches(self, texts: list[str | None], most: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of all stretches, and the texts they are from."""
        raw, length, text = words_of(texts)
        n = len(length)
        if not n or not self.landmarks:
            return np.zeros((0, len(self.landmarks))), np.zeros(0, np.int64)
        begin = np.ones(n, bool)
        begin[1:] = text[1:] != text[:-1]
        place = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        edge = np.flatnonzero(place % SPAN == 0)
        number = np.cumsum(place % SPAN == 0) - 1
        out, ends = np.zeros((len(edge), len(self.landmarks))), np.concatenate(([0], np.cumsum(length)))
        for k in range(0, n, 4 * CHUNK):
            e = min(n, k + 4 * CHUNK + 2)
            got = self.values(raw[ends[k] : ends[e]], length[k:e], text[k:e], most)[: min(4 * CHUNK, n - k)]
            which, at = np.unique(number[k : k + 4 * CHUNK], return_index=True)
            out[which] += np.add.reduceat(got, at, axis=0)
        return out, text[edge]


class Margins:
    """Weighted kernel values of stretches, without their values by landmark.

    A text's margin is linear in the kernel values of its words and windows, and a window is its words read as one: the
    weighted value of each distinct word and window is worked out once and kept, and stretches sum these numbers.
    """

    def __init__(self, kernel: Kernel, weights: np.ndarray):
        self.kernel, self.weights = kernel, weights
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.signs, self.length, self.value = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0)  # of words by number
        self.keys, self.joined = np.zeros(0, np.int64), np.zeros(0)  # of windows by key: their words' numbers plus one

    def _values(self, signs: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The weighted value of each of the words that ``signs`` holds end to end, read in the order of their lengths."""
        start, order, out = np.cumsum(length) - length, np.argsort(length, kind="stable"), np.zeros(len(length))
        for k in range(0, len(length), CHUNK):
            at = order[k : k + CHUNK]
            n = length[at]
            out[at] = self.kernel.values(signs[spread(start[at], n)], n, np.arange(len(at)), 1) @ self.weights
        return out

    def _numbers(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The words' numbers; words not met before get theirs and their value."""
        words, place = distinct(raw, length)
        get = self.number.get
        known = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(known < 0)
        if len(at):
            new = [words[k] for k in at.tolist()]
            known[at] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, known[at].tolist(), strict=True))
            signs, n = np.frombuffer(b"".join(new), np.uint8), np.array([len(w) for w in new], np.int64)
            self.signs, self.length = np.concatenate((self.signs, signs)), np.concatenate((self.length, n))
            self.value = np.concatenate((self.value, self._values(signs, n)))
        return known[place]

    def _windows(self, key: np.ndarray) -> np.ndarray:
        """The weighted values of windows by key."""
        found = pa.array(key).dictionary_encode()
        own = np.sort(found.dictionary.to_numpy())
        at = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = own[self.keys[at] != own] if len(self.keys) else own
        if len(new):
            parts = np.stack([new >> 2 * BIT, new >> BIT & (1 << BIT) - 1, new & (1 << BIT) - 1], axis=1) - 1
            real = parts >= 0
            n = np.where(real, self.length[parts], 0)
            first, count = (np.cumsum(self.length) - self.length)[parts[real]], n[real]
            value, keys = self._values(self.signs[spread(first, count)], n.sum(axis=1)), np.concatenate((self.keys, new))
            order = np.argsort(keys, kind="stable")
            self.keys, self.joined = keys[order], np.concatenate((self.joined, value))[order]
        return self.joined[np.searchsorted(self.keys, found.dictionary.to_numpy())][found.indices.to_numpy()]

    def stretches(self, texts: list[str | None], most: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """``Kernel.stretches`` times the weights, and the texts the stretches are from."""
        raw, length, text = words_of(texts)
        n = len(length)
        if not n or not self.kernel.landmarks:
            return np.zeros(0), np.zeros(0, np.int64)
        if len(self.number) > WORDS or len(self.keys) > WINDOWS:
            self._clear()
        if len(self.number) + n >= 1 << BIT:  # numbers might not fit a key
            value, text = self.kernel.stretches(texts, most)
            return value @ self.weights, text
        number = self._numbers(raw, length)
        out = self.value[number]
        for d in range(1, min(most, n)):
            at = np.flatnonzero((text[: n - d] == text[d:]) & (sum(length[k : n - d + k] for k in range(d + 1)) <= JOINED))
            key = number[at] + 1
            for k in (1, 2):
                key = key << BIT | (number[at + k] + 1 if k <= d else 0)
            out[at] += self._windows(key) if len(at) else 0.0
        begin = np.ones(n, bool)
        begin[1:] = text[1:] != text[:-1]
        place = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        edge = np.flatnonzero(place % SPAN == 0)
        return np.add.reduceat(out, edge), text[edge]


def _worst(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text the number of its stretch of greatest value (-1 without any); ``text`` ascends."""
    out = np.full(n, -1)
    order = np.lexsort((np.arange(len(text)), -value, text))
    which, at = np.unique(text[order], return_index=True)
    out[which] = order[at]
    return out


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  #: of the kernel values: the machine's weights through the Nystroem map
    bias: float
    slope: float
    shift: float

    def margins(self, kernel: Kernel | Margins, texts: list[str | None]) -> np.ndarray:
        value, text = (kernel if isinstance(kernel, Margins) else Margins(kernel, self.weights)).stretches(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, text, value)
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def scores(self, kernel: Kernel | Margins, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(kernel, texts) + self.shift, -60, 60)))


def candidates(texts: list[str | None], toxic: np.ndarray, most: int = CANDIDATES) -> list[bytes]:
    """Words of three signs or more that several training texts of label 1 have: those in most of them first, then by hash."""
    raw, length, text = words_of([t for t, y in zip(texts, toxic, strict=True) if y])
    ends = np.concatenate(([0], np.cumsum(length)))
    signs = raw.astype(np.uint8).tobytes()
    seen: dict[bytes, set] = {}
    for k in np.flatnonzero(length >= 3).tolist():
        seen.setdefault(signs[ends[k] : ends[k + 1]], set()).add(int(text[k]))
    shared = [(w, len(at)) for w, at in seen.items() if len(at) >= 2]
    return [w for w, _ in sorted(shared, key=lambda x: (-x[1], x[0]))[:most]]


def pursue(values: np.ndarray, toxic: np.ndarray, most: int, ridge: float = 1e-2) -> list[int]:
    """Columns of ``values`` (texts by candidates), one at a time: the one that goes best with the errors of the machine on those before."""
    s = np.where(toxic > 0, 1.0, -1.0)
    c = np.where(toxic > 0, 0.5 / max(1, (toxic > 0).sum()), 0.5 / max(1, (toxic == 0).sum()))
    norm = np.sqrt(c @ (values * values)) + 0.02
    chosen, least = [], NOISE / np.sqrt(max(1, (toxic > 0).sum()))  # what chance gives shrinks with the texts
    margin, left = np.zeros(len(s)), np.ones(values.shape[1], bool)
    while len(chosen) < most and left.any():
        pull = c * s * np.maximum(0.0, 1 - s * margin)
        gain = np.where(left, (pull - c * pull.sum()).astype(np.float32) @ values / norm, -np.inf)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        left[best] = False
        w, b = _machine(values[:, chosen], toxic, ridge, 12)
        margin = values[:, chosen] @ w + b
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared hinge loss with both classes weighing the same, by Newton steps on the active rows."""
    s = np.where(y > 0, 1.0, -1.0)
    a = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(a.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-9
    for _ in range(steps):
        on = s * (a @ w) < 1
        h = (a[on] * c[on, None]).T @ a[on] + np.diag(reg)
        new = np.linalg.solve(h, a[on].T @ (c[on] * s[on]))
        if np.abs(new - w).max() < 1e-10:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(toxic) over the margin (Newton, with smoothed targets)."""
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - t) + 1e-4 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


def _greatest(found: list[bytes], texts: list[str | None]) -> np.ndarray:
    """Per text and candidate the greatest kernel value of the text's words; every distinct word is read once."""
    number: dict[bytes, int] = {}
    found_in = []
    for k in range(0, len(texts), 128):  # some texts at a time: what they take besides stays small
        raw, length, text = words_of(texts[k : k + 128])
        own, place = distinct(raw, length)
        word = np.array([number.setdefault(w, len(number)) for w in own], np.int64)[place]
        found_in.append(np.unique(word * len(texts) + text + k))
    pairs = np.sort(np.concatenate(found_in))
    word, text = pairs // len(texts), pairs % len(texts)
    kernel, words, out = Kernel(found), list(number), np.zeros((len(texts), len(found)), np.float32)
    for k in range(0, len(words), 512):
        some = words[k : k + 512]
        value = kernel.values(np.frombuffer(b"".join(some), np.uint8).astype(np.int64), np.array([len(w) for w in some]), np.arange(len(some)), 1).astype(np.float32)
        i, j = np.searchsorted(word, (k, k + 512))
        raise_to_greatest(out, value, word[i:j] - k, text[i:j])
    return out


def raise_to_greatest(out: np.ndarray, value: np.ndarray, source: np.ndarray, target: np.ndarray, rows: int = 64) -> None:
    """``np.maximum.at(out, target, value[source])``: up to ``rows`` neighbouring rows of ``out`` at a time, each with one row of ``value``."""
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target))
    turn = place - np.maximum.accumulate(np.where(np.diff(target, prepend=-1) != 0, place, 0))  # a row of ``out`` has its sources in turn
    order = np.lexsort((turn, target // rows))
    source, target, turn = source[order], target[order], turn[order]
    cuts = np.flatnonzero((np.diff(turn) != 0) | (np.diff(target // rows) != 0)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(target)], strict=True):
        at = target[i:j]
        out[at] = np.maximum(out[at], value[source[i:j]])


def inserted(text: str) -> str:
    """The text with a letter more inside every word of five or more; where and which follows from the word."""

    def one(m: re.Match) -> str:
        w, h = m[0], zlib.crc32(m[0].lower().encode("utf-8", "replace"))
        k = 2 + h % (len(w) - 3)
        return w[:k] + chr(97 + h // 64 % 26) + w[k:]

    return re.sub(r"[^\W\d_]{5,}", one, text)


def _mapped(kernel: Kernel) -> np.ndarray:
    """The Nystroem map of the landmarks' kernel."""
    e, v = np.linalg.eigh(kernel.gram())
    return v @ np.diag(1 / np.sqrt(np.maximum(e, 0.05))) @ v.T


def _fit_stretches(x: np.ndarray, text: np.ndarray, toxic: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias: the machine on each text's worst stretch, some times over."""
    rows = np.concatenate((x, np.zeros((1, x.shape[1]), x.dtype)))  # a text without words is the empty bag
    w = x[toxic[text] > 0].mean(axis=0) - x[toxic[text] == 0].mean(axis=0) if 0 < toxic[text].sum() < len(text) else np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        w, b = _machine(rows[_worst(x @ w, text, len(toxic))], toxic, ridge)
    return w, b


def fit(texts: list[str | None], toxic: np.ndarray, ridge: float = 5e-3, folds: int = 3) -> Model:
    """Landmarks, Nystroem map, machine and calibration. Without both classes every score is the share of label 1."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    prior = float(np.log(share / (1 - share)))
    found = candidates(texts, toxic) if 0 < toxic.sum() < len(toxic) else []
    marks = [found[k] for k in pursue(_greatest(found, texts), toxic, LANDMARKS)] if found else []
    if not marks:
        return Model([], np.zeros(0), 0.0, 1.0, prior)
    # copies with inserted letters of the texts of label 1, and of about as many others
    n, ones = len(toxic), int(toxic.sum())
    more = np.flatnonzero((toxic > 0) | (np.arange(n) % max(1, (n - ones) // ones) == 0))
    every = [*texts, *(inserted(texts[i] or "") for i in more)]
    source, label = np.concatenate((np.arange(n), more)), np.concatenate((toxic, toxic[more]))
    kernel = Kernel(marks)
    mapped = _mapped(kernel)
    parts = [((v @ mapped).astype(np.float32), t + k) for k in range(0, len(every), 128) for v, t in [kernel.stretches(every[k : k + 128])]]
    x, text = np.concatenate([v for v, _ in parts]), np.concatenate([t for _, t in parts])
    del parts
    fold, margin = source % folds, np.zeros(len(label))
    rows = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
    for f in range(folds):
        out = fold == f
        place, own = np.cumsum(~out) - 1, ~out[text]
        if len(np.unique(label[~out])) == 2:
            w, b = _fit_stretches(x[own], place[text[own]], label[~out], ridge)
            margin[out] = (rows[_worst(x @ w, text, len(label))] @ w + b)[out]
    w, b = _fit_stretches(x, text, label, ridge)
    slope, shift = _logistic(margin[:n], toxic)
    return Model(marks, mapped @ w, b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Model:
    """Fit on at most ``sample`` labelled rows (doc_id, toxic), those whose doc_id hashes least.

    Null labels don't count; of several labels of an id the greatest holds, and rows that repeat an id are texts of
    their own. The sample bounds the rows; texts are read whole.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "_text").toArrow().sort_by("doc_id")
    return fit(rows.column("_text").to_pylist(), rows.column("toxic").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) to ``docs``; a column of that name is replaced, others pass through.

    Null and empty texts, and those without letters, have the score of an empty bag. Whole texts are read, however
    long; repeated rows and equal texts have equal scores. An empty table gives an empty result.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        kernel = Margins(Kernel(m.landmarks), m.weights)
        for b in batches:
            texts, out = b.column(text), []
            for i in range(0, b.num_rows, 512):
                out.append(m.scores(kernel, texts.slice(i, 512).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
