"""Main text of web pages by a maximum-scoring contiguous region.

A page is a sequence of words and tags. Tags score negative; a word scores a
positive base plus the weights of the elements that it lies in, so that words
of menus, links or adverts score negative too. One linear scan finds the
contiguous region with the largest sum. All weights are log-odds inside against
outside the content, learned from a bounded sample of labelled pages, those
that mark their content with <article> or <main>, and held by prior weights: of
every tag, and of every word in the class, id and role of containers (a name of
several words counts by their mean; paragraphs, headings and other elements of
text are judged by their tag alone). Extraction does not look at the marks, but
for one thing: a header inside of them is the article's own and stays.

From the region, elements are left out whose tag weighs under EXCLUDED, as it does
at first for menus, headers, footers, asides and forms, or whose name does so by a
word that stands for nothing else (MARKS: adverts, sidebars, cookies, reader
comments), and scripts, styles and hidden elements always. Other names are one piece
of evidence: an element whose name weighs under DOUBTED is left out if its name, its
words outside links and lists, and its link words sum up to less than 0. So a menu, a
share bar or a list of replies goes, and a paragraph in a section of the same name stays.
Character references are decoded, white space in a block becomes one space, and blocks
are joined by one line feed. A line break element is white space within its block.

Defined cases: null or empty html gives an empty text. Cut-off pages, stray or
unclosed tags are read as far as they go. Rows that repeat an id are extracted
each. Without labelled pages the prior weights are used.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import released, small_batches

#: Labelled pages that the weights are learned from, at most.
MAX_PAGES = 1000

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas select".split())
ENDLESS = frozenset("script style textarea title iframe template noscript".split())
BOILER = frozenset("nav footer aside form head header menu dialog fieldset datalist button".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption section article main header footer nav aside form figure figcaption address details summary body html hr fieldset".split())
CONTAINERS = frozenset("div section aside ul ol dl nav header footer form table figure details menu dialog".split())
KNOWN = VOID | RAW | BOILER | BLOCK | frozenset("a b i em strong span small sub sup u s q code kbd cite abbr label font center time mark del ins".split())
MARKED = frozenset("article main".split())
UNWEIGHED = MARKED | frozenset("html body".split())
# Elements that the next of their kind closes.
CLOSED_BY_NEXT = frozenset("p li a option tr td th".split())
# Words of class, id and role that mark boilerplate: those that stand for nothing else, notices, and those that articles have too.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets comment comments commentlist disqus respond nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead toolbar topbar pagination pager contentinfo teaser copyright".split()
)
NOTICES = frozenset("notice notices notification alert promotion register dialog disclaimer".split())
SHARED = frozenset("related recommended recommendations trending popular share sharing social reply replies discussion search skip complementary".split())
#: Elements whose words are no evidence that a name is wrong.
_NO_PROSE = ("a", "li", "button", "label", "h1", "h2", "h3", "h4", "h5", "h6")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_INNER = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: The score of a word in no weighed element, and what a word's score is held within.
BASE, LIMIT = 1.5, 4.0
#: Weights before any page is seen: of names that mark boilerplate, of a tag where it stands, and of single keys: links and lists, and a name that heads of sites and of articles share.
PRIOR_BOILER, PRIOR_NOTICE, PRIOR_SHARED, PRIOR_TAG = -4.0, -4.0, -2.0, -0.5
PRIORS = {"in:a": -1.2, "in:ul": -0.2, "in:ol": -0.2, "in:li": -0.2, "name:header": -2.4}
#: Words that a prior counts for: of names that mark boilerplate, and of others.
PRIOR_WORDS_BOILER, PRIOR_WORDS = 2000.0, 50.0
#: What the weights of boilerplate, container names, links, other elements and standing tags are held within: labelled pages of one
#: make, whose lists are all menus, must not part lists from articles.
LIMITS = {"boiler": (-6.0, 1.0), "name": (-6.0, 1.0), "link": (-1.5, 0.5), "in": (-0.4, 1.0), "tag": (-0.4, -0.02)}
#: Elements of this weight and less are left out; what a text run in them scores.
EXCLUDED, LEFT_OUT = -1.5, -1.0
#: Names of this weight and less are weighed against the words in the element: what their weight counts for in words, and what a link word counts for.
DOUBTED, NAME_WORDS, LINK_WORDS = -0.5, 4.0, -2.0


def _kind(key: str) -> str:
    kind, value = key.split(":", 1)
    if kind == "in" and value in BOILER or kind == "name" and (value in MARKS or value in NOTICES or value in SHARED):
        return "boiler"
    return "link" if key == "in:a" else kind


def prior(key: str) -> float:
    """The weight of a key before any page is seen; keys are in:<element>, name:<word> and tag:<element>."""
    kind, value = _kind(key), key.split(":", 1)[1]
    if key.startswith("name:") and (value in NOTICES or value in SHARED):
        return PRIOR_NOTICE if value in NOTICES else PRIOR_SHARED
    return PRIORS.get(key, PRIOR_BOILER if kind == "boiler" else PRIOR_TAG if kind == "tag" else 0.0)


def _names(name: str, attributes: str) -> list[list[str]]:
    """The words of each class, id and role of a container."""
    if not attributes or name not in CONTAINERS:
        return []
    given = (m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes))
    found = (_WORD.findall(_INNER.sub(" ", token).lower()) for value in given for token in value.split())
    return [words for words in found if words]


class Weights:
    """Learned weights by key; prior weights for the others."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.learned = learned or {}

    def of(self, key: str) -> float:
        found = self.learned.get(key)
        return prior(key) if found is None else found

    def element(self, name: str, attributes: str, in_content: bool) -> tuple[float, bool, float]:
        """(what the words in it score more, is it left out?, the weight of its name if that is to be weighed against its words, else 0)"""
        if name in UNWEIGHED:
            return 0.0, False, 0.0
        own = 0.0 if name == "header" and in_content else self.of(f"in:{name if name in KNOWN else 'other'}")
        weighed = [(sum(self.of(f"name:{w}") for w in words) / len(words), not MARKS.isdisjoint(words)) for words in _names(name, attributes)]
        sure = min((w for w, mark in weighed if mark), default=0.0)
        doubted = min((w for w, mark in weighed if not mark), default=0.0)
        out = bool(attributes and _HIDDEN.search(attributes)) or name in BOILER and own <= EXCLUDED or sure <= EXCLUDED
        if not out and doubted <= DOUBTED:
            return own + sure, False, doubted
        return own + min(sure, doubted), out, 0.0

    def tag(self, name: str) -> float:
        return self.of(f"tag:{name if name in KNOWN and name not in MARKED else 'other'}")


def tokens(page: str, weights: Weights, seen: Counter | None = None) -> list[tuple[str, str, float, bool]]:
    """(text, open or close; text or name; score; is it left out?) of each text run and tag.

    A run scores its words, but one word if they score negative, and LEFT_OUT where it is left out anyway: that, however long, does not part a region.
    seen: counts the words in each key, inside and outside marked content, and the tags.
    """
    out: list[tuple[str, str, float, bool]] = []
    stack: list[tuple] = []  # name, score, left out, mark, keys, words inside and outside at its start, and the weight of a doubted name with the tokens and evidence before it
    opened: Counter = Counter()
    score, left_out, content, inside, outside = BASE, 0, 0, 0, 0
    evidence = 0.0  # of words and link words so far
    gone: list[tuple[int, int]] = []  # tokens of the elements that were doubted and left out
    at, n = 0, len(page)
    lower = None

    def close() -> None:
        nonlocal score, left_out, content, evidence
        name, s, x, c, keys, i, o, doubted, first, before = stack.pop()
        opened[name] -= 1
        score, left_out, content = score - s, left_out - x, content - c
        if doubted and NAME_WORDS * doubted + evidence - before < 0:
            gone.append((first, len(out)))
            evidence = before
        if seen is not None:
            for key in keys:
                seen[key, True] += inside - i
                seen[key, False] += outside - o

    while at < n:
        match = _TAG.search(page, at)
        start = match.start() if match else n
        if start > at:
            text = page[at:start]
            words = len(text.split())
            if words and not left_out:
                evidence += LINK_WORDS * words if opened["a"] > 0 else 0 if any(opened[e] > 0 for e in _NO_PROSE) else words
            s = max(-LIMIT, min(LIMIT, score))
            out.append(("text", text, min(words, 1) * LEFT_OUT if left_out else words * s if s > 0 else min(words, 1) * s, left_out > 0))
            if seen is not None:
                good = content > 0 and not left_out
                inside, outside = inside + words * good, outside + words * (not good)
        if not match:
            break
        at = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        name = name.lower()
        closing, attributes = match[1] or match[4], match[3] or match[6] or ""
        out.append(("close" if closing else "open", name, weights.tag(name), left_out > 0))
        if seen is not None:
            seen[f"tag:{name if name in KNOWN and name not in MARKED else 'other'}", content > 0 and not left_out] += 1
        if closing:
            if opened[name] > 0:
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in VOID:
            continue
        if name in RAW:
            if attributes.endswith("/"):
                continue
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{name}", at)
            if end < 0:
                if name in ENDLESS:
                    break
                continue
            end = page.find(">", end)
            at = n if end < 0 else end + 1
            continue
        if name in CLOSED_BY_NEXT and stack and stack[-1][0] == name:
            close()
        if name == "body":  # a head that was never closed ends here
            while stack and stack[-1][0] != "html":
                close()
        s, x, doubted = weights.element(name, attributes, content > 0)
        c = name in MARKED and not left_out
        keys = []
        if seen is not None and name not in UNWEIGHED:
            keys = [f"in:{name if name in KNOWN else 'other'}", *(f"name:{w}" for words in _names(name, attributes) for w in words)]
        stack.append((name, s, x, c, keys, inside, outside, doubted, len(out), evidence))
        opened[name] += 1
        score, left_out, content = score + s, left_out + x, content + c
    while stack:
        close()
    if gone:
        edge, starts = Counter(), {first for first, _ in gone}  # each costs LEFT_OUT as a whole, so that it does not part a region
        for first, end in gone:
            edge[first] += 1
            edge[end] -= 1
        depth = 0
        for k, (kind, value, _, _) in enumerate(out):
            depth += edge[k]
            if depth:
                out[k] = kind, value, LEFT_OUT * (k in starts), True
    if seen is not None:
        seen["all", True] += inside
        seen["all", False] += outside
    return out


def counts(page: str) -> Counter:
    """(key, inside) -> words or tags of a labelled page; empty if it has no mark."""
    seen: Counter = Counter()
    tokens(page, Weights(), seen)
    return seen if seen["all", True] else Counter()


def learned(seen: dict[tuple[str, bool], int]) -> Weights:
    """Log-odds of the keys, held by their priors; standing tags stay negative."""
    totals = {kind: [1.0 + sum(n for (k, i), n in seen.items() if i == side and (k == "all" if kind == "word" else k.startswith("tag:"))) for side in (True, False)] for kind in ("word", "tag")}
    out = {}
    for key in {k for k, _ in seen} - {"all"}:
        kind = _kind(key)
        inside, outside = totals["tag" if kind == "tag" else "word"]
        a, b = seen.get((key, True), 0), seen.get((key, False), 0)
        held = PRIOR_WORDS_BOILER if kind == "boiler" else PRIOR_WORDS
        odds = math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside)
        low, high = LIMITS[kind]
        out[key] = min(max(((a + b) * odds + held * prior(key)) / (a + b + held), low), high)
    return Weights(out)


def region(scores: list[float]) -> tuple[int, int, float]:
    """(from, to, sum) of the contiguous part with the largest sum, by one scan."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, best_from, best_to = total, start, k + 1
    return best_from, best_to, best


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = tokens(page, weights or Weights())
    first, last, _ = region([t[2] for t in found])
    blocks: list[list[str]] = [[]]
    for kind, value, _, left_out in found[first:last]:
        if kind != "text":
            if value in BLOCK:
                blocks.append([])
            elif value == "br":
                blocks[-1].append(" ")
        elif not left_out:
            blocks[-1].append(value)
    texts = (" ".join(_html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(t for t in texts if t)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            if page:
                total.update(counts(page))
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["kind", "inside", "n"])


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Weights:
    """Weights from at most max_pages pages with a content mark, those with the least hashes of their ids."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    ids = marked.select(F.col("page_id").cast("long").alias("_id")).where("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(max_pages).distinct()
    sample = marked.select(F.col("page_id").cast("long").alias("_id"), F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "_id", "left_semi").select("html")
    rows = sample.mapInArrow(released(_count), "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # two per key, which are bounded by the sample
    return learned({(r.kind, r.inside): r.n for r in rows})


def _extractor(weight: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(p, weight) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    weight = train(pages, max_pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(released(_extractor(weight)), "page_id long, url string, text string, n_chars long")
