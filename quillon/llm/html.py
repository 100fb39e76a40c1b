"""Main-text extraction by a maximum-scoring subsequence over page tokens.

A page becomes a sequence of tokens: runs of words, and tags. Words score
positive where their surroundings look like content, tags and the words of
menus, adverts, forms and the like negative. One linear scan finds the
contiguous run of tokens with the largest sum, the content region; its words
are the text, but for those that score negative themselves.

The weights come from labelled pages: those whose markup names the content (an
``article`` or ``main`` element). ``LABELLED`` of them at most, picked by a hash
and read up to ``LABELLED_CHARS`` characters in all, are read to fit the
weights: a bound of the classifier's sample and of nothing else. Each counts in
four views, with and without the elements that name the content, and with and
without what marks boilerplate, so that weights for plain paragraphs, links and
``div``s are learned as well. A word's weight is the log odds of content by a
logistic regression on what it stands in, a tag's the share of such tags outside
content. Pages are then extracted whole, one by one, in time linear in their length.

Defined results: null or empty html gives an empty text; null page_id and url
stay null; repeated rows are rows; a page without words gives an empty text; an
unclosed element ends with its parent or where its kind of element must end; of
regions with equal sums the longest counts, and of these the first; very long pages are read whole; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import pick, table

LABELLED = 400
LABELLED_CHARS = 1 << 24
#: What a run of boilerplate tokens takes from a region at most: an advert doesn't cut a text in two.
RUN_COST = 3.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")

_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADINGS | frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that open a new block end a paragraph that was left open.
_ENDS_P = _HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hr main menu nav ol p pre section table ul".split())
_CONTENT = frozenset(("article", "main"))
_SECTION = frozenset("article main section nav header footer aside body html".split())
#: A new one of these ends an open one of the second, unless one of the third stands between.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

# Never article text: the elements, and words of class, id or role that tell the same.
_MARKED = _RAW | frozenset("head nav menu header footer aside form button select dialog svg canvas audio video object label fieldset".split())
_LISTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|announcement|newsletter|subscri\w*|signup|sign-up|sidebar\w*|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar|toolbar|comments?|commentlist|comment-\w+|disqus\w*|respond|replies|reply|related|recommend\w*|share|sharing|social\w*|popup|pop-up|modal|overlay|widgets?|pagination|pager|skip-link|search\w*|login)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: What a word can stand in, and the log odds that hold where labelled pages say nothing.
#: "named": the page has an article or main element; "plain": a div or section.
FEATURES = {"bias": 0.5, "named": -8.0, "content": 9.0, "paragraph": 1.0, "heading": 1.5, "link": -1.0, "item": -0.3, "cell": 0.0, "quote": 0.5, "plain": 0.0, "marked": -6.0}
_FEATURE_OF = {"article": "content", "main": "content", "p": "paragraph", "pre": "paragraph", "blockquote": "quote", "figcaption": "quote", "a": "link", "li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell", "div": "plain", "section": "plain"} | dict.fromkeys(_HEADINGS, "heading")
#: Labelled words count as so many in all against the odds above.
SAMPLE_WORDS = 2000.0
#: What the tag of an element takes away: a little, and more the oftener such tags stand outside content.
TAG_LEAST, TAG_MORE = 0.1, 1.0


@dataclass
class Token:
    """A run of words (name empty) or a tag, and the features of what it stands in."""

    name: str
    text: str
    inside: frozenset[str]


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def feature(name: str, raw: str) -> str | None:
    """What an element tells about the words in it."""
    if name in _MARKED:
        return "marked"
    kind = _FEATURE_OF.get(name)
    if not raw.strip(" /\t\r\n") or name in ("html", "body"):
        return kind
    attrs = attributes(raw)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES or _HIDDEN.search(attrs.get("style", "")):
        return "marked"
    if kind == "content":
        return "marked" if any("comment" in attrs.get(k, "").lower() for k in ("class", "id")) else kind
    return "marked" if any(_LISTED.search(attrs.get(k, "")) for k in ("class", "id", "data-role", "itemprop")) else kind


class _Open:
    """The open elements, with the place of the last of each name and of each kind."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.features: list[str | None] = []
        self.inside: list[frozenset[str]] = [frozenset()]
        self.places: dict[str, list[int]] = {}
        self.sections: list[int] = []
        self.marked: list[int] = []

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def push(self, name: str, what: str | None) -> None:
        at = len(self.names)
        self.names.append(name)
        self.features.append(what)
        up = self.inside[-1]
        self.inside.append(up if what is None or what in up else up | {what})
        self.places.setdefault(name, []).append(at)
        if name in _SECTION:
            self.sections.append(at)
        if what == "marked":
            self.marked.append(at)

    def leave(self, at: int) -> None:
        """End the element at a place and all in it."""
        while len(self.names) > at:
            name = self.names.pop()
            self.places[name].pop()
            self.inside.pop()
            if name in _SECTION:
                self.sections.pop()
            if self.features.pop() == "marked":
                self.marked.pop()


_STAYS = frozenset("section div body html main article td li blockquote aside header footer nav form".split())


def tokens(page: str) -> list[Token]:
    """The tokens of a page in order; what scripts, styles and the like hold is left out."""
    out: list[Token] = []
    open_ = _Open()
    closes = {m[1].lower(): m.start() for m in _CLOSE.finditer(page)}  # the last end tag of each name
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            out.append(Token("", page[at:start], open_.inside[-1]))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            place = open_.last(name)
            # an end tag is part of its element; a stray end of an inner element never closes a section around it
            closed = place >= 0 and (name in _SECTION or not open_.sections or open_.sections[-1] <= place)
            out.append(Token(name, "", open_.inside[place + 1] if closed else open_.inside[-1]))
            if closed:
                open_.leave(place)
            continue
        if name in _SECTION and name not in ("section", "html", "body"):
            # a new section ends what can't hold it, and before the content a menu or advert that is never closed
            while open_.names and open_.names[-1] not in _STAYS:
                open_.leave(len(open_.names) - 1)
            if name in _CONTENT and open_.marked and closes.get(open_.names[open_.marked[0]], -1) < at:
                open_.leave(open_.marked[0])
        elif name in _ENDS:
            same, stop = _ENDS[name]
            place = open_.last(*same)
            if place > open_.last(*stop):
                open_.leave(place)
        if name in _ENDS_P and (place := open_.last("p")) > open_.last("table", "td", "th", "caption", "button", "object"):
            open_.leave(place)
        what = feature(name, m["attrs"])
        out.append(Token(name, "", open_.inside[-1] | {what} if what else open_.inside[-1]))
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at) if closes.get(name, -1) >= at else None
            at = close.end() if close else (end if name in ("script", "style") else at)
        elif name not in _VOID and not m["attrs"].endswith("/"):
            open_.push(name, what)
    return out


def _views(inside: frozenset[str], named: bool) -> list[frozenset[str]]:
    """What a labelled word stands in: as it is, without the content's name, without marks, and without both."""
    bare = inside - {"marked"} | ({"plain"} if "marked" in inside else set())
    unnamed = [x - {"content"} | ({"plain"} if "content" in x else set()) for x in (inside, bare)]
    return [x | {"named"} if named else x for x in (inside, bare)] + unnamed


@dataclass
class Weights:
    words: dict[str, float]
    tags: dict[str, float]

    def word(self, inside: frozenset[str], named: bool) -> float:
        z = self.words["bias"] + sum(self.words[f] for f in inside) + (self.words["named"] if named else 0.0)
        if "marked" in inside:
            return min(z, -0.5)
        # words are positive unless a link or the page's own naming says otherwise
        return z if named or "link" in inside else max(z, 0.1)

    def tag(self, name: str) -> float:
        return -TAG_LEAST - TAG_MORE * self.tags.get(name, 0.5)


def fit(pages: list[str]) -> Weights:
    """Weights from pages whose markup names the content."""
    seen: Counter[tuple[frozenset[str], bool]] = Counter()
    tags: dict[str, list[float]] = {}
    for page in pages:
        got = tokens(page)
        named = any("content" in t.inside for t in got)
        for t in got:
            good = "content" in t.inside and "marked" not in t.inside
            if t.name:
                tags.setdefault(t.name, [1.0, 1.0])[good] += 1
            elif n := len(t.text.split()):
                for view in _views(t.inside, named):
                    seen[view, good] += n
    names = list(FEATURES)
    w = np.array([FEATURES[f] for f in names])
    if seen:
        x = np.array([[f == "bias" or f in view for f in names] for view, _ in seen], float)
        y = np.array([good for _, good in seen], float)
        n = np.array(list(seen.values()), float)
        n *= min(1.0, SAMPLE_WORDS / n.sum())
        prior = w.copy()
        for _ in range(50):  # Newton steps of a convex function
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (y - p)) - (w - prior))
            w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
    return Weights(dict(zip(names, w.tolist(), strict=True)), {t: out / (out + inside) for t, (out, inside) in tags.items()})


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; the longest of ties, the first of these."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and i + 1 - start > best_at[1] - best_at[0]):
            best, best_at = total, (start, i + 1)
    return best_at


def score(got: list[Token], weights: Weights) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether it is a run of words that scores positive."""
    named = any("content" in t.inside and "marked" not in t.inside and not t.name and t.text.strip() for t in got)
    of: dict[frozenset[str], float] = {}
    scores, good, run = [], [], 0.0
    for t in got:
        if t.inside not in of:
            of[t.inside] = weights.word(t.inside, named)
        w = of[t.inside]
        good.append(not t.name and w > 0)
        s = weights.tag(t.name) if t.name else w * len(t.text.split())
        if "marked" in t.inside:
            # inside the element that the page names as its content, boilerplate costs a region nothing
            s = 0.0 if named and "content" in t.inside else max(s, -RUN_COST - run)
            run += s
        elif t.name or t.text.strip():
            run = 0.0
        scores.append(s)
    return scores, good


def extract(page: str | None, weights: Weights, region=best_region) -> str:
    if not page:
        return ""
    got = tokens(page)
    scores, good = score(got, weights)
    start, end = region(scores)
    blocks: list[list[str]] = [[]]
    for t, keep in zip(got[start:end], good[start:end], strict=True):
        if t.name:
            if t.name in _BLOCK:
                blocks.append([])
        elif keep:
            blocks[-1].append(t.text)
    texts = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks if b)
    return " ".join(t for t in texts if t)


def fit_pages(pages: DataFrame, labelled: int = LABELLED, chars: int = LABELLED_CHARS) -> Weights:
    h = pick(pages, page_id="long", html="string").filter(F.lower("html").rlike(r"<(article|main)[\s>]") & (F.length("html") * labelled <= chars * 8))
    h = h.select("html", F.xxhash64("page_id", F.length("html")).alias("pick"), F.length("html").alias("size"))
    # the smallest hashes first, then the pages up to the last of them that the bound holds
    total, last = 0, None
    for r in h.select("pick", "size").orderBy("pick", "size").limit(labelled).collect():
        total += r["size"]
        if total > chars:
            break
        last = r["pick"]
    rows = [] if last is None else h.filter(F.col("pick") <= last).orderBy("pick", "size").limit(labelled).collect()
    return fit([r["html"] for r in rows])


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h, weights) for h in b.html]
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": text, "n_chars": [len(t) for t in text]})

    p = pick(pages, page_id="string", url="string", html="string")
    return p.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_pages(pages))


#: For pages whose markup is what these tables hold: an ``article`` of p, h1, br and b, and three named references.
OP9_SQL = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
        '&quot;', '"'), '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&'), '\s+', ' ', 'g')) AS text
      FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages))
"""
