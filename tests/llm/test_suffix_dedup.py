"""Repeated 200-byte strings against brute force; the loser tree against sorting."""

import hashlib
import random

import pytest

from pagegraph.llm import suffix_dedup as S


def brute(rows):
    seen: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, b) in enumerate(data):
        for p in range(len(b) - 199):
            seen.setdefault(b[p : p + 200], []).append((k, p))
    gone = [bytearray(len(b)) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + 200] = b"\1" * 200
    out = []
    for (i, b), g in zip(data, gone, strict=True):
        kept = bytes(c for c, x in zip(b, g, strict=True) if not x)
        out.append((i, len(b), sum(g), sum(x and not (k and g[k - 1]) for k, x in enumerate(g)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    parts = [prose(n) for n in (30, 45, 70, 200)] + [prose(60)[:k] for k in (198, 199, 200, 201)] + ["ab" * 150, "x" * 205]
    rows = [(i, "".join(rng.choice([prose(rng.randint(0, 40)), rng.choice(parts), rng.choice(parts)[rng.randint(0, 60) :]]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "z" * 3000), (73, prose(800)), *rows[:2], (74, rows[3][1])]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_spans string")
    got = S.remove_repeats(df, run_bytes=5000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert {r.kept_text for r in got if r.doc_id == 70} == {None}


def test_long_texts_over_slabs(spark):
    """Texts longer than a slab, with passages that lie across its border; null ids and repeated rows."""
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passage = prose(400)
    rows = [(i, prose(S.SLAB - 150 * i) + passage + prose(20_000 + 9_000 * i) + passage[:250]) for i in range(3)]
    rows += [(None, passage), (None, passage), (None, None), (None, None)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)


def test_repeats_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 5, 9):
        runs = []
        for _ in range(k):
            rows = sorted({bytes(rng.choices(b"ab", k=12)) for _ in range(rng.randint(0, 40))})
            runs.append((rows, [0, *(S._common(a, b, 0) for a, b in zip(rows, rows[1:], strict=False))][: len(rows)]))
        got = [(h, row) for h, _, row in S.merge([iter(list(zip(rows, lcps, strict=True))) for rows, lcps in runs])]
        want = sorted(r for rows, _ in runs for r in rows)
        assert [r for _, r in got] == want
        assert [h for h, _ in got] == [0, *(S._common(a, b, 0) for a, b in zip(want, want[1:], strict=False))][: len(want)]
