"""Quality, toxicity, HTML extraction and embedding near-dedup."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pagegraph.llm import embedding_dedup as E
from pagegraph.llm import html_text as H
from pagegraph.llm import quality as Q
from pagegraph.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


# -- quality --------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.select("doc_id", F.col("quality").alias("grade"))
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    got = Q.grade(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).select("grade", "p_above").toPandas()
    y, p = got.grade.to_numpy(), got.p_above.to_numpy()
    assert auc(p, y) > 0.99
    assert ((p >= Q.TAIL) == (y == 1)).mean() > 0.98
    assert (p[y == 1] >= Q.TAIL).mean() > 0.995


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    x = np.zeros((600, Q.WIDTH), np.float32)
    y = rng.integers(0, 4, 600).astype(float) * 2
    x[:, 3] = y / 6 + rng.normal(0, 0.05, 600)
    m = Q.fit(x, y)
    assert list(m.grades) == [0, 2, 4, 6] and (np.diff(m.thresholds) > 0).all()
    tails = m.tails(x @ m.weights.astype(np.float32))
    assert (np.diff(tails, axis=1) <= 1e-9).all()
    assert np.corrcoef(m.grades[0] + tails @ np.diff(m.grades), y)[0, 1] > 0.9


def test_scores_equal_features():
    rng = random.Random(1)
    texts = pa.array([None, "", "a", "ab", "Some words, some words!", "é" * 50, " ".join(rng.choices(["x", "Yy", "z9"], k=400))])
    m = Q.Ordinal(np.array([0.0, 1.0]), np.random.default_rng(2).normal(size=Q.WIDTH), np.zeros(1))
    assert np.allclose(m.scores(texts), Q.features(texts).astype(float) @ m.weights, atol=1e-4)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", None), (3, "the text", 1.0), (3, "the text", 1.0)], "doc_id long, text string, p_top double")
    for labels in ([], [(3, 1.0)], [(1, 0.0), (3, 1.0), (2, None)]):
        model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, grade double"))
        got = Q.grade(docs, model)
        assert got.columns == ["doc_id", "text", "expected_grade", "p_top", "p_above"] and got.count() == 4
    assert Q.grade(docs.limit(0), model).count() == 0


# -- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = X.op7_toxicity(spark, SF).join(rows, "doc_id").where("held_out").toPandas()
    y = got.toxic.to_numpy()
    assert auc(got.score.to_numpy(), y) > 0.93
    assert got.predicted[y == 0].mean() < 0.03 and got.predicted[y == 1].mean() > 0.75
    for lang in ("en", "de", "fr", "es"):
        own = got[got.lang == lang]
        assert auc(own.score.to_numpy(), own.toxic.to_numpy()) > 0.88, lang


def slow_kernel(a, b):
    """The word kernel from its definition: sums over pairs of equal triples, each by its span."""

    def subsequences(w):
        c = (X.START, *w)
        return [((c[i], c[j], c[k]), X.DECAY ** (k - i + 1)) for i in range(len(c)) for j in range(i + 1, len(c)) for k in range(j + 1, min(len(c), i + X.REACH))]

    def weight(n):
        return max(sum(X.DECAY ** (2 * (k - i + 1)) for i in range(n + 1) for j in range(i + 1, n + 1) for k in range(j + 1, min(n + 1, i + X.REACH))), 1e-12) ** 0.5

    return (sum(u * v for x, u in subsequences(a) for y, v in subsequences(b) if x == y) / weight(len(a)) / weight(len(b))) ** X.POWER


def test_toxicity_kernel_is_the_defined_one():
    rng = random.Random(2)
    signs = lambda t: tuple(int(x) for x in X.words_of([t])[0])
    marks = [bytes(signs(w)) for w in ("idiot", "scum", "zug", "réeuxvi", "дурак", "aaaa")]
    kernel = X.Kernel(marks)
    texts = ["", None, "?!", "id iot a scxum i di ot zu g", "Réeuxvi! réeux дура́к ДУРАК aaaaa", " ".join("".join(rng.choices("idotscumé", k=rng.randint(1, 9))) for _ in range(50))]
    got, text = kernel.stretches(texts)
    want, owner = [], []
    for t, x in enumerate(texts):
        raw, length, _ = X.words_of([x])
        ends = [0, *length.cumsum().tolist()]
        words = [tuple(int(v) for v in raw[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
        for k in range(0, len(words), X.SPAN):
            bag = []
            for i in range(k, min(k + X.SPAN, len(words))):
                joined = [sum(words[i : i + n], ()) for n in (1, 2, 3) if i + n <= len(words)]
                bag += [w for n, w in enumerate(joined) if n == 0 or len(w) <= X.JOINED]
            want.append([sum(slow_kernel(w, tuple(m)) for w in bag) for m in marks])
            owner.append(t)
    assert text.tolist() == owner and np.allclose(got, want)
    gram = kernel.gram()
    assert np.allclose(gram, [[slow_kernel(tuple(a), tuple(b)) for b in marks] for a in marks])
    assert np.linalg.eigvalsh(gram).min() > -1e-9 and np.allclose(gram, gram.T)


def test_toxicity_words():
    words = lambda t: [bytes(w) for raw, n, _ in [X.words_of([t])] for w in np.split(raw.astype(np.uint8), n.cumsum()[:-1])]
    assert words("Idiot, i-d.i o t!") == words("idiot idi o t") and words("i * d  i o\nt x") == words("idiotx") and words("a b cd") == words("A B CD")
    assert len(words("你好" * 40)) == -(-80 // X.PIECE) and words("ÉTÉ дурак") == words("été ДУРАК") != words("ete durak")
    assert [len(x) for x in X.words_of([None, "", " 12 ", "\ud800"])] == [0, 0, 0]
    raw, length, text = X.words_of(["i d", "i o t", "ab"])
    assert length.tolist() == [1, 1, 3, 2] and text.tolist() == [0, 0, 1, 2]


def test_toxicity_distinct_words_and_windows_are_read_once(monkeypatch):
    rng, read = random.Random(3), []
    kernel = X.Kernel([bytes(X.words_of([w])[0].astype(np.uint8)) for w in ("idiot", "scum", "réeux")])
    weights = np.array([0.7, -0.2, 1.1])
    words = ["id", "iot", "a", "sc", "um", "réeux", "дурак", "scxum", "extraordinarily", "i"]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)), "i d i o t", "你好" * 40]
    want, owner = kernel.stretches(texts)
    values = X.Kernel.values
    monkeypatch.setattr(X.Kernel, "values", lambda self, raw, length, *more: read.append(len(length)) or values(self, raw, length, *more))
    m = X.Model(kernel.landmarks, weights, 0.0, 1.0, 0.0)
    assert np.allclose(m.margins(kernel, ["id iot " * 200]), m.margins(kernel, ["id iot " * 16])) and sum(read) < 30
    for most in (X.WINDOWS, 50):  # the second begins anew between calls
        monkeypatch.setattr(X, "WINDOWS", most)
        margins = X.Margins(kernel, weights)
        for k in range(0, len(texts), 50):
            got, text = margins.stretches(texts[k : k + 50])
            mine = (owner >= k) & (owner < k + 50)
            assert (text + k).tolist() == owner[mine].tolist() and np.allclose(got, want[mine] @ weights)
    monkeypatch.setattr(X, "BIT", 5)  # numbers that don't fit a key
    assert np.allclose(X.Margins(kernel, weights).stretches(texts)[0], want @ weights)


def test_toxicity_looks_up_triples_of_words_only():
    rng = random.Random(5)
    signs = lambda t: X.words_of([t])[0]
    kernel = X.Kernel([bytes(signs(w).astype(np.uint8)) for w in ("idiot", "scum", "lo", "aaaa")])
    words = ["".join(rng.choices("idotscumé", k=rng.randint(1, 24))) for _ in range(300)]
    raw, length, looked = np.concatenate([signs(w) for w in words]), np.array([len(w) for w in words]), []
    held = kernel.held

    class Held:
        def __getitem__(self, code):
            looked.append(len(code))
            return held[code]

    kernel.held = Held()
    got = kernel.values(raw, length, np.arange(300), 1)
    assert np.allclose(got, [[slow_kernel(tuple(int(x) for x in signs(w)), tuple(m)) for m in kernel.landmarks] for w in words])
    assert sum(looked) == sum(max(0, n + 1 - j) for n in length.tolist() for _, j, _ in X._TRIPLES)
    assert kernel.values(raw[:0], length[:0], length[:0]).shape == (0, 4) and X.Kernel([]).values(raw, length, np.arange(300)).shape == (300, 0)


def test_toxicity_greatest_values_of_texts():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5000):
        value, source, target = rng.normal(size=(40, 7)), rng.integers(0, 40, n), rng.integers(0, 150, n) ** 2 // 150
        got, want = np.zeros((150, 7)), np.zeros((150, 7))
        X.raise_to_greatest(got, value, source, target)
        np.maximum.at(want, target, value[source])
        assert (got == want).all()
    found, texts = [bytes(X.words_of([w])[0].astype(np.uint8)) for w in ("idiot", "scum")], [None] * 128 + ["an idixot scum", None, "scxum um", "?", "an"] * 60
    words = [[tuple(int(x) for x in X.words_of([w])[0]) for w in (t or "").split()] for t in texts]
    assert np.allclose(X._greatest(found, texts), [[max([slow_kernel(w, tuple(m)) for w in own if w], default=0) for m in found] for own in words])


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["th", "er", "on", "an", "re", "ing", "ed"], k=rng.randint(1, 4)))
    bad = ["idiot", "scum", "disgusting", "moron", "zug"]
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    toxic = [" ".join(rng.sample([*(word() for _ in range(50)), *rng.choices(bad, k=3)], 53)) for _ in range(50)]
    m = X.fit(clean + toxic, np.array([0] * 150 + [1] * 50))
    kernel = X.Kernel(m.landmarks)
    return clean, lambda t: float(m.scores(kernel, [t])[0])


def test_toxicity_tolerates_gaps_and_splits():
    clean, score = planted()
    for base in clean[:4]:
        assert score(base) < 0.3 and score(" ".join([base] * 50)) < 0.3
        for w in ("idiot", "IDIOT", "id-iot", "i.d.i.o.t", "id1iot", "i d i o t", "idiots", "mo*ron", "id iot", "i * d * i * o * t", "i  d\n i o t", "sc um", "zug", "z u g", "i di ot"):
            assert score(f"{base} {w} {base}") >= 0.3, w
            assert score(f"{' '.join([base] * 40)} {w} {base}") >= 0.3, w
        for w in ("idixot", "moxron", "scxum"):
            assert score(f"{base} {w} {base}") > score(f"{base} {base}"), w


def test_toxicity_edges(spark):
    long = "word " * 60_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "y"), (3, "x"), (4, long), (5, "some idiot"), (6, "an idiot")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (3, 1)], [(2, None)], [(1, 0), (2, 0), (4, 0), (5, 1), (6, 1), (6, 0), (None, 1)]):
        model = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = X.score(docs.withColumn("score", docs.doc_id), model).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.text == "x"}) == 1 and len({r.score for r in got if not r.text}) == 1
    assert len(model.landmarks) == 1
    assert X.score(docs.limit(0), model).count() == 0


# -- pages ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad <p>no</p> --><div class="ad">Buy this.</div><article><h1>Head &amp; tail</h1><p><b>First  para&#233;graph
 of it.<br>More<p>Second &lt;one&gt;</p><aside>Side</aside><form><p>Mail</p></form><div class="comments"><p>I disagree</p></div></article><footer>&copy; x</footer></body></html>"""


def test_html_rules(spark):
    assert H.main_text(PAGE) == "Head & tail\n\nFirst paraégraph of it. More\n\nSecond <one>"
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == H.main_text("<script>x") == ""
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a></div><p>" + "It is the case that this was for all of you. " * 5 + "</p><p>Short one</p><div class='sidebar'>x</div><p>" + "And that is what they have to do. " * 6 + "</p><ul><li><a href=3>Link list</a></ul>"
    assert H.main_text(plain).split("\n\n")[1] == "Short one" and "Home" not in H.main_text(plain) and "Link" not in H.main_text(plain)
    assert H.inherit(["short", "bad", "short", "short", "good"]) == ["bad", "bad", "bad", "good", "good"] and H.inherit(["short"]) == ["good"]
    assert H.main_text("<head><title>x</title><body class='has-sidebar'><div class='with-ads no-js'><p>Text here</p></div><p class=ad>Buy</p>") == "Text here"
    assert H.main_text("<p>a < b and <b>c</b><p class=\"x>y") .startswith("a < b and c")
    long = "<article><p>" + "word " * 60_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (2, None, None, None), (3, "", long, 1)], "page_id long, url string, html string, n_chars int")
    got = H.extract(df).collect()
    assert sorted(r.n_chars for r in got) == sorted([len(H.main_text(PAGE))] * 2 + [0, 5 * 60_000 - 1])
    assert H.extract(df.limit(0)).count() == 0


def test_html_attributes():
    for kept in ("style='overflow:hidden'", 'title="A hidden gem"', "href=/hidden/path", 'href="/x?id=comment"', "data-class='ad'", 'title="class=ad"', "data-hidden", "aria-hidden='false'", 'style="--x:display:none"', 'class="" title="ad"'):
        assert H.main_text(f"<p>Before</p><div {kept}><p>Kept</p></div><p>It is <a {kept}>one</a> of the many words that we have in this place for all of you to read</p>") == "Before\n\nKept\n\nIt is one of the many words that we have in this place for all of you to read", kept
    for gone in ("hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display : none'", "class=ad", "title='x' id = \"comments\"", "role=navigation"):
        assert H.main_text(f"<p>Before</p><div {gone}><p>Gone</p></div>") == "Before", gone


PROSE = "It is the case that this was for all of you and that is what they have to do. " * 4


def test_html_article_is_a_prior():
    text, teaser = PROSE.strip(), "One more thing that you may read."
    got = H.main_text(f"<body><div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div><div><article><p>{teaser}</p></article></div><p>&copy; Firm</p>")
    assert got.startswith(f"Title\n\n{text}\n\n{text}") and teaser in got
    page = f"<main><h1>Title</h1><p>17</p><p>{PROSE}</p><pre>x = 1</pre></main>%s<div><p>Firm</p></div>"
    assert H.main_text(page % "<article class='comment'><p>I disagree with all of it.</p></article>") == f"Title\n\n17\n\n{text}\n\nx = 1"
    assert H.main_text("<article class='post tag-ads comments-open'><p>Text</p></article>") == "Text"
    links = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    assert H.main_text(f"<article><h1>Title</h1>{links}<h2>Links</h2>{links}<p>{PROSE}</p></article>") == f"Title\n\n{text}"


def test_html_names_of_wrappers():
    text = PROSE.strip()
    for name in ("content-sidebar-wrap", "page-with-sidebar", "layout-sidebar", "elementor-widget-container", "widget", "comments"):
        for inner in (f"<article><p>{PROSE}</p></article>", f"<p>{PROSE}</p>", f"<main><p>Few words</p></main><p>{PROSE}</p>"):
            got = H.main_text(f"<div class={name}>{inner}<div class=sidebar><p>{PROSE[:60]}</p></div></div><div class=ad>And this is for you.</div>")
            assert got == "\n\n".join(["Few words"] * ("Few" in inner) + [text]), (name, inner)
    parts = "".join(f"<div class='elementor-widget-container'><p>{PROSE}</p></div>" for _ in range(5))
    assert H.main_text(f"<div class=nav-menu><p>{PROSE}</p></div>{parts}") == "\n\n".join([text] * 5)
    assert H.main_text(f"<article><p>{PROSE}</p></article><div id=comments>{f'<p>{PROSE}</p>' * 5}</div>") == text
    assert H.main_text(f"<p>{PROSE}<span class=share>Share this</span></p>") == text


def _article_words(page):
    import html
    import re

    article = re.search(r"<article>(.*?)</article>", page, re.S)
    return html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()


def test_html_matches_documents(spark):
    """Pages of the test tables hold documents: their words must come out, and nothing of the rest."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(400).collect():
        assert H.main_text(r.html).split() == _article_words(r.html), r.page_id


@pytest.mark.parametrize("names", [True, False])
def test_html_rules_decide_without_marks(spark, monkeypatch, names):
    """The same with no article element, and with no class names either: density, length, links and neighbours decide."""
    if not names:
        monkeypatch.setattr(H, "NOISE", set())
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert H.main_text(page).split() == _article_words(r.html), r.page_id


NOISY = [
    "<nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>News</a></li></ul></nav>",
    "<div><a href=/a>Home page</a> | <a href=/b>News of the day</a></div>",
    "<header><p>The site of all that is to be had</p></header>",
    "<aside><p>And this is what you have to see for the rest of it.</p></aside>",
    "<form><p>Your mail</p><input name=m><button>Send</button></form>",
    "<div class='cookie-notice'><p>It is with these that we do what we do for you.</p></div>",
    "<script>var t='<p>It is the case that</p>';</script>",
    "<!-- <p>It is the case that this was for all of you</p> -->",
    "<p>Sign up for the letter that we send to all of you.</p>",
    "<p>Subscribe to all that we have</p>",
]
REPLIES = [
    "<div><h3>Comments</h3><div><p>I do not think that it is the case that this was for all of them.</p></div><div><p>" + "And that is what you have to do with it. " * 6 + "</p></div></div>",
    "<section><h2>3 Comments</h2><p>Bob: this is not for me.</p></section>",
    "<div class=comments><p>" + "I have to say that it is not for all of us. " * 5 + "</p></div>",
]


@pytest.mark.parametrize("seed", range(40))
def test_html_planted_pages(seed):
    """Pages put together from an article's blocks and noise: what comes out is the article, whatever wraps it."""
    rng = random.Random(seed)
    stop = "the of and to in a is that it for on was as with by at from this are be".split()
    word = lambda: rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choices(["ka", "lo", "mi", "ren", "st"], k=rng.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    title, paragraphs = line(6), [line(rng.randint(25, 90)) for _ in range(rng.randint(2, 6))]
    some = rng.randrange(1, len(paragraphs))
    paragraphs.insert(some, line(3))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    replies = rng.choice(REPLIES)
    if rng.random() < 0.5:  # inside the article
        body = body[: body.rindex("<p>")] + rng.choice(NOISY[8:]) + body[body.rindex("<p>") :] + (replies if rng.random() < 0.5 else "")
    wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<div class='header-image'>%s</div>", "<div class='article search-result'>%s</div>", "<section id=content>%s</section>"])
    page = "<html><body>" + "".join(rng.sample(NOISY[:8], rng.randint(1, 6))) + wrap % body + rng.choice(["", replies]) + "".join(rng.sample(NOISY[:8], 2)) + "<footer><p>&copy; The firm</p></footer></body></html>"
    assert H.main_text(page) == "\n\n".join([title, *paragraphs]), page


def test_html_headings_named_like_comments_hold_their_section_only():
    text = PROSE.strip()
    assert H.main_text(f"<article><p>{PROSE}</p><h2>Comments</h2><p>{PROSE}</p><h2>More</h2><p>{PROSE}</p></article>") == f"{text}\n\nMore\n\n{text}"
    assert H.main_text(f"<article><p>{PROSE}</p><p>Comments by all of them were to be had.</p><p>{PROSE}</p></article>").count(text) == 2
    assert H.main_text("<h1>Few words</h1><p>Here</p>") == "Few words\n\nHere" and H.main_text("<div>Bare</div>") == "Bare"


# -- vectors --------------------------------------------------------------------------------------------------------


def brute_vectors(rows):
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(np.array(r[1], float) != 0) for r in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least: dict = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


@pytest.mark.parametrize("tile", [4, 2048])
def test_vectors(spark, tile):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            base = rng.normal(size=8)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((i, [float(np.float32(v)) for v in base * rng.choice([1, 3]) + rng.normal(0, rng.choice([0, 0.05, 0.1]), 8)], label))
                i += 1
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] + [0.0] * 6, 0), (903, [nan] * 8, 0), (904, [inf] * 8, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, rows[0][1], 0), (909, rows[0][1], 1), (910, [1e-30] * 8, 1), (911, [1e30] * 8, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, tile=tile).collect())
    assert got == brute_vectors(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_forest_reaches_all():
    rng = np.random.default_rng(7)
    for n in (1, 2, 30, 200):
        mask = rng.random((n, n)) < 1.2 / n
        mask |= mask.T
        np.fill_diagonal(mask, False)
        want = np.arange(n)
        while True:
            new = np.array([min([want[i], *want[mask[i]]]) for i in range(n)])
            if (new == want).all():
                break
            want = new
        assert (E._forest(mask) == want).all()


def test_bounds_are_rigorous():
    rng = np.random.default_rng(5)
    x = E.unit(rng.normal(size=(300, 64)))
    y = E.unit(x + rng.normal(0, 0.025, x.shape))
    mask, full = E.linked(x, y, 0.98)
    assert (mask == (x @ y.T >= 0.98)).all() and full < 3000
