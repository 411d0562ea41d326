"""The pipeline's stages: their decisions, the columns they return, and the guard around them."""

import numpy as np

import corpus_pipeline as P
from pagegraph.llm import decontaminate, ngram_join
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, columns = docs, docs.columns
    for name, stage in P.STAGES:
        after = stage(spark, before, SF)
        after = spark.createDataFrame(after.collect(), after.schema)
        rows, was = {r.doc_id: r for r in after.collect()}, {r.doc_id: r for r in before.collect()}
        if name != "mix":
            assert after.columns == columns
        if name == "quality":
            known = [d for d in was if d in labels]
            assert np.mean([(d in rows) == (labels[d] > 0) for d in known]) > 0.97
        elif name == "near_duplicates":
            assert set(rows) == {d for d, _, c in brute_groups([(r.doc_id, r.text) for r in was.values()]) if d == c}
        elif name == "repeats":
            want = {i: n - gone for i, n, gone, _, _ in brute_repeats([(r.doc_id, r.text) for r in was.values()])}
            assert set(rows) == set(was)
            assert all(abs(len(rows[d].text.encode()) - want[d]) <= 6 * (rows[d].text != was[d].text) for d in rows)
        elif name == "leaks":
            automaton = [decontaminate.build(benchmark)]
            assert set(rows) == {d for d, r in was.items() if not decontaminate.scan(r.text, automaton)[2]}
        else:
            assert all(0 < r.taken <= 3 * r.size and r.text == was[r.doc_id].text for r in rows.values())
        assert len(rows) > 20, name
        before = after


CLASHES = ["size", "source_size", "target", "taken", "rest", "row", "print", "key", "p_above", "p_top", "_run", "n_removed", "kept_text", "component_id", "n_words", "spans", "contaminated", "_text", "_"]


def clashing(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], columns)


def odd_rows():
    good = spark_texts()
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(good)]
    rows += [(None, good[0], None, None, None), (None, good[1] + " and then it was", None, None, 5), (0, good[2], "en", "books", 1), (0, good[2], "en", "books", 1)]
    rows += [(900, None, None, "web", None), (901, "", "en", None, 0), (902, " \n", "en", "web", 2), (903, " ".join(f"word{k}" for k in range(60_000)), "en", "web", 7)]
    return rows + [(None, None, None, None, None)] * 2


def spark_texts():
    import random

    rng = random.Random(3)
    return [" ".join(rng.choices("the of and to in a is that it for on was as with by at from this are be this".split(), k=80)).capitalize() + "." for _ in range(12)]


def test_odd_rows(spark):
    """Nulls, repeated ids and rows, empty and long texts, and columns that clash with what stages add."""
    docs = clashing(spark, odd_rows())
    rows = docs.collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source))
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF).collect()
        if name == "mix":
            sizes = {key(r): len((r.text or "").split()) for r in rows}
            assert got[0].__fields__ == [c for c in docs.columns if c not in P.MIXED] + list(P.MIXED)
            assert all(r.size == sizes[key(r)] and 0 < r.taken <= 3 * r.size for r in got)
            own = {s: [r for r in got if r.source == s] for s in ("web", "books", None)}
            assert all(abs(sum(r.taken for r in own[s]) - own[s][0].target) <= 1 for s in own)
            continue
        assert got and got[0].__fields__ == docs.columns
        assert all([getattr(r, c) for c in CLASHES] == CLASHES for r in got), name
        if name == "near_duplicates":
            numbers = brute_groups([(i, r.text) for i, r in enumerate(rows)])
            assert len(got) == sum(d == c for d, _, c in numbers)
            least = {}
            for (_, _, c), r in zip(sorted(numbers), rows, strict=True):
                least.setdefault(c, []).append(r)
            order = lambda r: (r.doc_id is None, r.doc_id or 0)
            assert sorted(str(r.doc_id) for r in got) == sorted(str(min(g, key=order).doc_id) for g in least.values())
        elif name == "repeats":
            assert len(got) == len(rows)
            want = brute_repeats([(i, r.text) for i, r in enumerate(rows)])
            assert sorted(len((r.text or "").encode()) for r in got) == sorted(n - gone for _, n, gone, _, _ in want)
        elif name == "leaks":
            assert sorted(map(key, got)) == sorted(map(key, rows))


def test_empty_tables(spark):
    docs = clashing(spark, [])
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_run(spark):
    assert P.run(spark, SF).count() > 20 and len(P.STAGES) == 5 and ngram_join.SHINGLE == 5


def test_entry_has_the_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
