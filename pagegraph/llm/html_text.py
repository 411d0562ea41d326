"""HTML extraction: two-pass block rules.

A scanner cuts a page into text blocks at block-level tags, leaving out what can't be text (scripts, styles,
comments, forms), boilerplate elements (navigation, headers, footers, asides) and what is hidden. Pass one classes
every block by stop-word density, length and link density as good, bad or short (ambiguous). In pass two ambiguous
blocks inherit the label that their nearest decided neighbours share; boilerplate that was left out counts as a bad
neighbour. Tags and names are votes in this:

- the role of a block's tag: a paragraph asks pass one for less length than text that stands bare in a container, and
  where neighbours differ it is good and the bare text bad; a heading goes with the block after it;
- an article or main element: inside it pass one asks for less density, its blocks have their neighbours inside it,
  and bad ones on both sides are needed to make an ambiguous block bad;
- a class, id or role that names a boilerplate region makes its text bad, unless an article stands in the region or
  most of the page's dense text has the same name around it (``trusted``);
- a heading that announces reader comments makes the rest of its section bad, wherever it stands.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

# Elements by role in a page.
BLOCK = {*"address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()}
RAW = {*"script style noscript template svg math iframe object canvas audio video textarea title xmp noembed noframes".split()}
DROP = {*"nav header footer aside form button select label input menu dialog head".split()}
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
MAIN = {"article", "main"}
#: Words of class, id and role values that mark regions which are no main text.
NOISE = {*"ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related share sharing social comment comments respond disqus cookie cookies consent notice newsletter subscribe subscription signup login popup modal pagination pager toolbar skip hidden contentinfo complementary search".split()}
#: Beginnings of class names that say something about a page's other regions.
ABOUT = {"has", "with", "no", "without", "is", "js"}
#: Beginnings and ends of class names that say something about an article's subject or state.
SUBJECT, STATE = {"tag", "category", "term", "topic"}, {"open", "closed"}
# Frequent words of English, German, French and Spanish.
STOP = {*"the of and to in a is that it for on was as with by at from this are be or an which not have he his they i you we but had has were their its if will would can there what all about when so no more out up into than them then some could these two may other only new do any".split(), *"der die das und in zu den von mit ist im für auf nicht ein eine als auch an es dem sich des er sie dass aus bei war nach wird sind noch wie einem über einen so zum haben nur oder aber vor zur bis mehr durch man sein wurde".split(), *"de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux d l s cette été mais comme elle nous vous leur sans entre deux même".split(), *"de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()}

# How short blocks about subscriptions, sharing, cookies and adverts begin, and blocks that announce reader comments (whole).
ASIDES = re.compile(r"\W*(?:sign up|subscribe\b|join our (?:newsletter|mailing list)|get (?:our|the) newsletter|newsletter\b|follow us|share this|related (?:articles|posts|stories)|advertisement\b|sponsored\b|we use cookies|this (?:site|website) uses cookies|jetzt abonnieren|abonnieren sie|melden sie sich (?:jetzt |hier )?(?:an|für|zu)\b|anzeige\b|wir verwenden cookies|abonnez-vous|inscrivez-vous|publicité\b|nous utilisons des cookies|suscríbete|suscríbase|regístrate|publicidad\b|utilizamos cookies)", re.I)
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader |user )?comments?|replies|responses|leave a (?:comment|reply)|post a comment|join the (?:discussion|conversation)|kommentare?|leserkommentare|kommentar schreiben|commentaires?|laisser un commentaire|comentarios?|deja un comentario)(?:\s*\(?\d+\)?)?\W*", re.I)
# Roles of block elements. All others are containers.
TEXT = {*"p pre blockquote dd dt li td th caption figcaption summary address".split()}
HEADING = {f"h{i}": i for i in range(1, 7)}
REGION = {*"nav header footer aside form menu dialog".split()}

LINKS, DENSE, SPARSE, LONG, SHORT = 0.4, 0.2, 0.1, 140, 50
_TAG = re.compile(r"<(?:(!--)|(![^>]*>|\?[^>]*>)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)")
#: An attribute: its name, then the value in double quotes, in single quotes or bare.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


def _says(attributes: str, article: bool = False) -> tuple[bool, list[str]]:
    """Whether an element is hidden, and the words of its class, id and role that name a region which is no main text."""
    hidden, names = False, []
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDES.search(value):
            hidden = True
        if name in ("class", "id", "role"):
            for word in html.unescape(value).lower().split():
                parts = _PARTS.findall(word)
                if article and parts and (parts[0] in SUBJECT or parts[-1] in STATE):
                    continue
                if parts and parts[0] not in ABOUT and not NOISE.isdisjoint(parts):
                    names.append(word)
    return hidden, names


@dataclass(eq=False)
class Region:
    """An element with names of NOISE; around: its names and those of the regions around it; holds: an article or main without such a name stands in it."""

    names: list[str]
    parent: Region | None
    around: frozenset[str]
    holds: bool = False
    stays: bool | None = None


@dataclass(eq=False)
class Node:
    """An open block element: its tag, the element around it and the number of blocks before its end."""

    tag: str
    parent: Node | None
    end: int | None = None


class Piece(NamedTuple):
    """A stretch of a block's text: inside a link, inside an article or main without names of NOISE, and the innermost region around it."""

    text: str
    link: bool
    marked: bool
    region: Region | None


class Found(NamedTuple):
    """A block in pieces, the number of the outermost article or main around it (or 0), and its element. Without pieces: boilerplate that was left out."""

    section: int
    parts: list[Piece]
    node: Node | None


class Block(NamedTuple):
    """A block's text (empty for boilerplate), its letters inside links, its section, and whether names or a comments heading make it bad."""

    text: str
    linked: int
    section: int
    tag: str
    bad: bool


def pieces(page: str) -> list[Found]:
    """All blocks in page order, and a mark where boilerplate stood."""
    out: list[Found] = []
    parts: list[Piece] = []
    stack: list[tuple[str, bool, Region | None, Node | None]] = []  # open elements, whether each is dropped, the region that it starts and its block element
    regions: list[Region | None] = [None]  # open ones, after a None
    dropped = anchors = main = clean = section = 0
    at, size = 0, len(page)

    def flush() -> None:
        if parts:
            out.append(Found(section if main else 0, parts.copy(), stack[-1][3] if stack else None))
            parts.clear()

    def leave(i: int) -> None:
        """Element i of the stack ends."""
        nonlocal dropped, anchors, main, clean
        name, drop, region, node = stack.pop(i)
        if name in BLOCK and node is not None:
            node.end = len(out)
        dropped -= drop
        anchors -= name == "a"
        main -= name in MAIN
        clean -= name in MAIN and region is None
        if region is not None:
            regions.remove(region)

    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at and not dropped:
            parts.append(Piece(page[at:end], anchors > 0, clean > 0, regions[-1]))
        if not m:
            break
        at = m.end()
        if m[1]:
            close = page.find("-->", m.start() + 4)
            at = close + 3 if close >= 0 else size
            continue
        if m[2]:
            continue
        name = m[4].lower()
        if m[3]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for j in range(len(stack) - 1, i - 1, -1):
                        leave(j)
                    break
            continue
        if name in RAW:
            if name in BLOCK:
                flush()
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name == "br":
            if not dropped:
                parts.append(Piece(" ", False, clean > 0, regions[-1]))
            continue
        if name in BLOCK or name in DROP:
            flush()
        if name in VOID or m[5].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            leave(len(stack) - 1)
        if name == "a" and anchors:  # links don't nest
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "a":
                    leave(i)
                    break
        if name == "body":  # whatever stood open before it has ended
            stack.clear()
            del regions[1:]
            dropped = anchors = main = clean = 0
        hidden, names = (False, []) if name in ("html", "body") or not m[5] else _says(m[5], name in MAIN)
        drop = name in DROP or hidden
        around = regions[-1].around if regions[-1] else frozenset()
        region = Region(names, regions[-1], around if around.issuperset(names) else around.union(names)) if names and not drop else None
        if name in MAIN:
            section += not main
            main += 1
            if region is None:
                clean += 1
                if not drop and not dropped:
                    g = regions[-1]
                    while g and not g.holds:
                        g.holds, g = True, g.parent
        node = stack[-1][3] if stack else None
        stack.append((name, drop, region, Node(name, node) if name in BLOCK else node))
        if name in REGION and not dropped:
            out.append(Found(section if main else 0, [], None))
        if region is not None:
            regions.append(region)
        dropped += drop
        anchors += name == "a"
    flush()
    return out


def join(parts: list[Piece]) -> tuple[str, int]:
    """A block's text and its letters inside links."""
    return _SPACE.sub(" ", html.unescape("".join(p.text for p in parts))).strip(), sum(len(_SPACE.sub(" ", html.unescape(p.text))) for p in parts if p.link)


def trusted(found: list[Found], first: list[str]) -> None:
    """Sets ``stays`` of every region with text: it and all around it have an article or main in them, or only names that stand around more than half of the page's good text.

    ``first`` has the blocks' labels without names. A name of nothing but words of NOISE (``comments``, no
    ``content-sidebar``) doesn't get the latter if text of an article or main stands outside it: comments may well be
    longer than what they are about.
    """
    total, size, none = 0, Counter(), frozenset()
    outside: set[frozenset[str]] = set()  # the names around the text of articles and main elements
    for f, label in zip(found, first, strict=True):
        for p in f.parts:
            names = p.region.around if p.region else none
            if label == "good":
                total += len(p.text)
                for n in names:
                    size[n] += len(p.text)
            if p.marked and p.text.strip():
                outside.add(names)
    common = Counter(n for names in outside for n in names)

    def stays(g: Region) -> bool:
        return g.holds or all(2 * size[n] > total and (not NOISE.issuperset(_PARTS.findall(n)) or common[n] == len(outside)) for n in g.names)

    for g in (p.region for f in found for p in f.parts):
        chain = []
        while g and g.stays is None:
            chain.append(g)
            g = g.parent
        for g in reversed(chain):
            g.stays = (g.parent is None or g.parent.stays) and stays(g)


def commented(found: list[Found]) -> set[int]:
    """Numbers of the blocks that a heading about comments (or a short block that says no more) announces, itself included.

    It speaks for the rest of the element around it; straight inside an article, main or body up to the next heading
    of its rank.
    """
    out: set[int] = set()
    for i, f in enumerate(found):
        if i in out or not f.parts or f.node is None or sum(len(p.text) for p in f.parts) > SHORT or not COMMENTS.fullmatch(join(f.parts)[0]):
            continue
        around, rank = f.node.parent, HEADING.get(f.node.tag, 7)
        end = len(found) if around is None or around.end is None else around.end
        if around is None or around.tag in ("article", "main", "body", "html"):
            end = next((j for j in range(i + 1, end) if (g := found[j].node) is not None and HEADING.get(g.tag, 7) <= min(rank, 6)), end)
        out.update(range(i, end))
    return out


def blocks(page: str) -> list[Block]:
    """Blocks with their votes; stretches inside a block whose names make them boilerplate are left out of it."""
    found = pieces(page)
    replies = commented(found)
    if any(p.region for f in found for p in f.parts):
        trusted(found, [classify(*join(f.parts), f.node.tag if f.node else "", False) if f.parts else "bad" for f in found])
    out = []
    for i, f in enumerate(found):
        kept = [p for p in f.parts if not p.region or p.region.stays]
        text, linked = join(kept or f.parts)
        if text or not f.parts:
            out.append(Block(text, linked, f.section, f.node.tag if f.node else "", i in replies or not kept))
    return out


def classify(text: str, linked: int, tag: str, marked: bool) -> str:
    """First pass: good, bad, or short (ambiguous), for a block inside (``marked``) or outside of an article or main."""
    if linked > LINKS * len(text) or len(text) < LONG and ASIDES.match(text):
        return "bad"
    words = _WORD.findall(text.lower())
    density = sum(w in STOP for w in words) / max(1, len(words))
    if marked:
        return "good" if density >= SPARSE else "short"
    if tag in HEADING:
        return "short"
    if len(text) < SHORT:
        return "bad" if linked else "short"
    if density >= DENSE and (tag in TEXT or len(text) >= LONG) or density >= SPARSE and len(text) >= LONG:
        return "good"
    return "bad" if density < SPARSE and linked else "short"


def inherit(labels: list[str], votes: list[int] | None = None, default: str = "good") -> list[str]:
    """Second pass: ambiguous blocks take the label that their nearest decided neighbours share.

    Where these differ, a positive vote makes the block good and a negative one bad; without a vote the nearer
    neighbour holds, and of two as near the good one. With no neighbour decided they have the default.
    """
    n, before, after = len(labels), [None] * len(labels), [None] * len(labels)
    last = None
    for i in range(n):
        if labels[i] != "short":
            last = i
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] != "short":
            last = i
        after[i] = last
    out = []
    for i, label in enumerate(labels):
        if label == "short":
            b, a, vote = before[i], after[i], votes[i] if votes else 0
            if b is None and a is None:
                label = default
            elif b is None or a is None:
                label = "good" if vote > 1 else labels[a if b is None else b]
            elif labels[a] == labels[b]:
                label = labels[a]
            elif vote:
                label = "good" if vote > 0 else "bad"
            else:
                label = labels[b] if i - b < a - i else labels[a] if a - i < i - b else "good"
        out.append(label)
    return out


def _vote(tag: str, marked: bool) -> int:
    """2: bad between two bad ones only; 1: good between unlike ones; -1: bad between unlike ones."""
    return 2 if marked else 1 if tag in TEXT or tag in HEADING else -1


def decide(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.text or not b.section:
            groups.setdefault(b.section, []).append(i)
    good = [False] * len(found)
    left: list[int] = []  # ambiguous ones
    for section in sorted(groups, reverse=True):  # what is outside comes last
        at = groups[section]
        first = ["bad" if found[i].bad or not found[i].text else classify(found[i].text, found[i].linked, found[i].tag, section > 0) for i in at]
        votes = [_vote(found[i].tag, section > 0) for i in at]
        second = inherit(first, votes, "bad" if any(good) else "good")
        if not section:  # a heading goes with what it heads
            for k in range(len(at) - 2, -1, -1):
                if first[k] == "short" and found[at[k]].tag in HEADING:
                    second[k] = second[k + 1]
        for i, label, was in zip(at, second, first, strict=True):
            good[i] = label == "good"
            if was == "short":
                left.append(i)
    if not any(good):  # a page of nothing but ambiguous text
        some = [i for i in left if _vote(found[i].tag, False) > 0] or left
        for i in some:
            good[i] = True
    return good


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty or text-free pages."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, decide(found), strict=True) if good)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to every row of ``pages``; columns of these names are replaced, unless one is the html itself.

    Null pages have empty text; whole pages are read, however long. Rows are independent: repeated rows give repeated
    results, an empty table an empty one.
    """
    pages = pages.select("*", pages[column].alias("_page")).drop("text", "n_chars")
    schema = T.StructType([*(f for f in pages.schema.fields if f.name != "_page"), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column("_page")]
            kept = [c for c in b.schema.names if c != "_page"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
