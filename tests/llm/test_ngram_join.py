"""Shingle similarity and components against brute force."""

import random
import re

import numpy as np
import pytest

from pagegraph.llm import components as C
from pagegraph.llm import ngram_join as J


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed", range(4))
def test_join(spark, seed, monkeypatch):
    if seed == 3:  # a short list of frequent features, so that both modes are used
        monkeypatch.setattr(J, "FREQUENT_AT_MOST", 10**9)
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "é"]) if rng.random() < 0.2 else "".join(rng.choices("abcdef", k=4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 80, 200]))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(w) // 45])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 2)] = [word()] * rng.randint(0, 2)
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "the"), (904, "THE"), (905, "the the"), (3, texts[0])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    assert got == brute(rows)


def test_signatures_are_shared():
    """Any two sets that are similar enough share a signature, with and without frequent features."""
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 300))
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        union = max(n, 1)
        drop = int(rng.integers(0, union // 5 + 1))
        a_cut = int(rng.integers(0, drop + 1))
        a, b = np.unique(base[a_cut:]), np.unique(base[: n - (drop - a_cut)])
        common = np.sort(base[rng.random(n) < rng.choice([0, 0.3, 0.8, 1.0])])
        if not len(a) or not len(b) or 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
            continue
        sig, who, core = J.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), common)
        x, y = ({(s, c) for s, w, c in zip(sig.tolist(), who, core.tolist(), strict=True) if w == i} for i in (0, 1))
        both = {s for s, _ in x} & {s for s, _ in y}
        assert np.array_equal(a, b) or any((s, True) in x | y for s in both), (len(a), len(b))


def test_long_texts_and_filters(spark, monkeypatch):
    """Very long texts, null ids, and a filter of nodes that is nearly full."""
    monkeypatch.setattr(J, "LEAST_BITS", 64)
    monkeypatch.setattr(J, "MOST_BITS", 64)
    rng = random.Random(5)
    long = rng.choices([f"w{i}" for i in range(40_000)], k=30_000)
    near = long[:100] + ["x"] + long[100:]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:26_000])), (4, " ".join(long[:20_000])), (None, " ".join(near)), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [c for _, _, c in got] == [1, 1, 1, 4, None, 1] and got[-1][:2] == (None, got[1][1])


def test_join_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.getrandbits(40), rng.getrandbits(40)) for _ in range(50)]
    chain = [rng.getrandbits(50) for _ in range(120)]
    edges += list(zip(chain, chain[1:], strict=False)) + [(7, 7), (None, 3)] + edges[:3]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[c] for c in chain}) == 1 and 7 not in got and 3 not in got
    assert len(set(got.values())) == 51
    assert all(got[r] == r for r in got.values())
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
