"""Token counts, mixing, URL filters and decontamination against brute force on small fixtures."""

import hashlib
import random
import re

import pytest

from pagegraph.llm import decontaminate as D
from pagegraph.llm import mixing as M
from pagegraph.llm import token_count as K
from pagegraph.llm import url_filter as U

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_pieces(word: bytes, pieces: set) -> int:
    n, at, start = 0, 0, True
    while at < len(word):
        fits = [e for e in range(len(word), at, -1) if (word[at:e], start) in pieces or (start and False)]
        if not fits and start:
            start = False
            continue
        at = fits[0] if fits else at + 1
        n, start = n + 1, False
    return n


def test_piece_counter_is_greedy():
    rng = random.Random(5)
    for _ in range(60):
        pieces = [(bytes(rng.choices(b"abc", k=rng.randint(1, 4))), rng.random() < 0.4) for _ in range(rng.randint(0, 25))]
        counter = K.PieceCounter(pieces)
        for _ in range(60):
            w = bytes(rng.choices(b"abcd", k=rng.randint(0, 14)))
            assert counter.count(w) == slow_pieces(w, set(pieces)), (pieces, w)


def test_token_counts_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "the  end\nof", "en", "a", 3), (3, "the  end\nof", "en", "a", 3), (4, "x" * 200_000, "en", "a", 1)]
    got = K.count_tokens(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 1)]
    assert all(r.n_tokens >= r.n_words for r in got)
    clash = spark.createDataFrame([(1, "a b")], "n_words long, text string")
    assert K.count_tokens(clash).collect()[0].n_words == 2
    assert K.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def brute_targets(sizes: dict) -> dict:
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        t = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b", "ä", "Z"][: 2 + seed]) if i % 3 else "a", rng.choice([0, 1, 7, 300, 5000])) for i in range(150)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = M.mix(df, block=64).collect()
    sizes: dict = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, M.mix(df.repartition(7), block=64).collect()))


def test_mix_slots_are_even(spark):
    t = spark.createDataFrame([("a", 5000, 6000.0), ("b", 4000, 3000.0), ("c", 3000, 3000.0)], "source string, source_size long, target double")
    slots = sorted((r.slot, r.key.name) for r in M.schedule(t, block=10).collect() if r.slot is not None)
    for upto in (100, 300, 700):
        assert abs(sum(k == "a" for _, k in slots[:upto]) - upto / 2) < 8


def test_mix_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    got = M.mix(spark.createDataFrame([(1, None, 0), (2, "a", None)], "doc_id long, source string, size long")).collect()
    assert [r.taken for r in got] == [0, 0]


def test_urls(spark):
    urls = [None, "no host", "http://A.Example.COM/en/7x?q", "http://example.com/en/1", "https://x.net/de/8", "https://b.example.net/de/81#f", "http://notexample.com", "https://k.org/es/", "://", "http://h?/en/", "http://bad.biz/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3][2:] == ("com/en/", "block") and got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block")
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("org/es/", "block") and got[8][:2] == ("", "") and got[9] == ("h", "", None, "allow")
    more = spark.createDataFrame([(100 + i, "http://bad.biz/a" if i < 40 else "http://good.biz/a", "") for i in range(80)], pages.schema)
    bad = spark.createDataFrame([(100 + i, int(i < 40)) for i in range(80)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in U.filter_urls(pages.union(more), bad).collect()}
    assert got[10] == "block" and got[100] == "block" and got[179] == "allow"


def brute_bounds(hosts):
    """Bounds per site, domain and suffix, and of all, from (host, bad) by the formulas of the prior, level by level."""
    rows = [(*slow_levels(h), y) for h, y in hosts if h is not None and y is not None]

    def posterior(names, parent):
        count = {}
        for name, up, y in names:
            n, bad, _ = count.get(name, (0, 0, up))
            count[name] = n + 1, bad + y, up
        spread = sum((b - n * parent[u]) ** 2 / (parent[u] * (1 - parent[u])) for n, b, u in count.values())
        pairs = sum(n * (n - 1) for n, _, _ in count.values())
        rho = max(0.001, min(0.5, (spread - len(names)) / pairs)) if pairs else 0.001
        return {k: beta(parent[u] * (1 / rho - 1) + b, (1 - parent[u]) * (1 / rho - 1) + n - b) for k, (n, b, u) in count.items()}

    def beta(a, b):
        return a / (a + b), a / (a + b) - U.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5

    mean = lambda found: {k: m for k, (m, _) in found.items()}
    bad = sum(y for *_, y in rows)
    top = beta(bad + 0.5, len(rows) - bad + 0.5)
    suffix = posterior([(s, "", y) for _, _, s, y in rows], {"": top[0]})
    domain = posterior([(d, s, y) for _, d, s, y in rows], mean(suffix))
    return posterior([(h, d, y) for h, d, _, y in rows], mean(domain)), domain, suffix, top


def slow_levels(host):
    site = re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", host.split("@")[-1]))
    labels = site.split(".")
    if site.startswith("[") or (len(labels) == 4 and all(x.isdigit() for x in labels)):
        return site, site, site
    k = next((k for k in (3, 2) if ".".join(labels[-k:]) in U.SUFFIXES and len(labels) >= k), 1)
    return site, ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def test_url_levels(spark):
    hosts = ["", "h", "a.b", "x.a.b", "good.co.uk", "w.good.co.uk", "co.uk", "bad.biz:8080", "u:p@bad.biz:80", "bad.biz.", "192.168.0.1:80", "1.2.3.4", "1.2.3.4.5", "[::1]:80", "me.github.io", "é.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in df.select(*U.levels(df.host)).collect()]
    assert got == [slow_levels(h) for h in hosts]


@pytest.mark.parametrize("seed", range(3))
def test_url_shrinkage(spark, seed):
    rng = random.Random(seed)
    names = ["a.x.com", "b.x.com", "b.x.com:80", "y.com", "q.co.uk", "w.q.co.uk", "r.co.uk", "1.2.3.4", "solo"]
    rate = {n: rng.random() for n in names}
    hosts = [(h, int(rng.random() < rate[h])) for h in rng.choices(names, k=120)] + [(None, 1), ("y.com", None)]
    site, domain, suffix, lower = U.host_reputation(spark.createDataFrame(hosts, "host string, bad int"))
    want = brute_bounds(hosts)
    for got, key, brute in ((site, "site", want[0]), (domain, "domain", want[1]), (suffix, "suffix", want[2])):
        rows = {r[key]: (r.m, r.lower) for r in got.collect()}
        assert rows.keys() == brute.keys()
        assert all(abs(rows[k][i] - brute[k][i]) < 1e-9 for k in rows for i in (0, 1))
    assert abs(lower - want[3][1]) < 1e-12


def test_url_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 200_000), (1, "http://a.com/" + "x" * 200_000), (None, "http://u@b.com:80/p"), (3, None)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = sorted((str(r.page_id), r.host, len(r.path), r.rule, r.verdict) for r in U.filter_urls(pages, none).collect())
    assert got == [("1", "a.com", 200_001, None, "allow")] * 2 + [("3", "", 0, None, "allow"), ("None", "u@b.com:80", 2, None, "allow")]
    assert U.filter_urls(pages.limit(0), spark.createDataFrame([(1, 1)], "page_id long, bad int")).count() == 0
    many = spark.createDataFrame([(i, f"http://bad.biz:{i}/") for i in range(30)], pages.schema)
    bad = spark.createDataFrame([(i, 1 if i < 20 else None) for i in range(30)], "page_id long, bad int")
    assert {r.verdict for r in U.filter_urls(many, bad).collect()} == {"block"}


def brute_leaks(text, items):
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    hit, ids = set(), set()
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            win = w[k : k + 10]
            for p in range(len(words) - len(win) + 1):
                if words[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(i)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def test_leaks_many_words():
    """More words than signs below the surrogates, and the size of an automaton."""
    words = [f"w{i}" for i in range(70_000)]
    shard = D.Shard([(i, " ".join(words[i : i + 14])) for i in range(0, 70_000, 14)])
    assert shard.automaton.get_stats()["nodes_count"] <= 31 * 70_000
    n, mask, ids = D.scan("x " + " ".join(words[55_286:55_310]) + " y", [shard])
    assert n == 26 and mask.sum() == 24 and ids == {55_286, 55_300} - ({55_300} if 55_310 - 55_300 < 10 else set())


def test_leaks(spark):
    rng = random.Random(1)
    vocab = ["a", "B", "é", "x9", "of", "ß", "日本"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 10, 14])))) for i in range(12)] + [(50, None), (51, "..!"), (3, "of a-x9")]
    docs = [(i, rng.choice(["", "-", "\t"]).join(rng.choices(vocab, k=30)) + ". " + rng.choice(items[:12])[1].upper().replace("É", "é").replace("ß".upper(), "ß")) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "!?"), (92, "!?"), (93, "a " * 50_000)]
    frame, bench = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, spans string, n_hit int"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.load_shards(bench, 100))) > 3 and len(list(D.load_shards(bench))) == 1
    got = D.decontaminate(frame, bench, states=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, D.decontaminate(frame, bench).collect()))
    assert D.decontaminate(frame.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="parts"):
        list(D.load_shards(bench, most_bytes=10))
    want = sorted((i, *brute_leaks(t, items)) for i, t in docs if i != 93)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got if r.doc_id != 93) == want
    texts = dict(docs)
    for r in got:
        for s in r.spans:
            part = texts[r.doc_id].encode()[s.start : s.end].decode()
            assert part and part[0] not in " .-\t"
    none = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0
