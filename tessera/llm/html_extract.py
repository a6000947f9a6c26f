"""Main-text extraction by the maximum-scoring contiguous region.

A page becomes a sequence of events: tags, each with a negative score, and the words of blocks, whose
score is the log-odds of their kind (block element, inside a link or not, inside a menu-like
container or not) to stand inside the article. The weights are fitted on labelled pages: those whose
own markup says where the article is (``<article>`` or ``<main>``); they are counted over all such
pages and are a few hundred numbers whatever the corpus. One linear scan finds the contiguous
region of the largest sum; blocks of menu-like containers inside it (adverts, notices, forms,
comments) are left out, and so is everything that is no text.

A container is menu-like by its element, its role or its being hidden, or by the words of its class and
id, each a feature with a fitted weight: listed words start from a prior and move with the share of the
text under them that labelled pages put into their articles. A name does not condemn what holds the
page's title or main part; and where all that would leave a page without text, names count for nothing,
then forms and headers neither.

Defined results: null or empty html gives the empty text; unclosed containers end with the one around
them; an element that is not read (script, svg) and never closed is passed over, its content kept; a tag
that never ends is text; a comment that never ends is none; a page without any block that scores above
zero has the empty text; pages of any length and depth take time in proportion to their length;
repeated rows are answered once each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import table

#: A tag: quotes count after an equals sign, as in browsers; matched possessively, so in linear time.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")

#: Elements by what they do (fixed values). RAW holds plain text, NESTED other elements; neither is read.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "head"}
NESTED = {"template", "object", "svg", "math", "canvas", "audio", "video", "select"}
HARD_MENU, SOFT_MENU = {"nav", "footer", "aside", "menu"}, {"form", "button", "dialog", "fieldset", "label", "input", "option"}
MENU = HARD_MENU | SOFT_MENU
CONTAINER = {"div", "section", "article", "main", "header", "body", "html", "table", "ul", "ol", "dl", "figure", "details", "center"} | MENU
BLOCK = CONTAINER | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "figcaption", "blockquote", "pre", "address", "hr", "summary", "legend"}
ARTICLE = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Words of class and id names, with all that begin so where a star stands (fixed values): of menu-like containers, of
#: articles, of neither; and words that say that something is or is not there.
MENU_WORDS = "ad ads advert* sponsor* promo* banner nav* menu* breadcrumb* masthead header footer sidebar aside complementary widget* related recommend* share sharing social comment comments commentlist disqus reply replies respond cookie* consent gdpr notice* newsletter subscri* signup login search popup modal overlay pager pagination toolbar skip alert contentinfo".split()
ARTICLE_WORDS = "article post entry story content text body hentry blog prose".split()
PLAIN_WORDS = "main page site global container wrapper wrap area box inner outer list item items block section bar button buttons link links panel row col column columns group holder region zone slot unit left right top bottom primary secondary sticky fixed mobile desktop js form field title heading head meta info posts articles entries stories us our the".split()
SAYS = {"has", "have", "with", "no", "without", "hide", "show", "not"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Scores before any page has been seen, and the bounds of fitted ones.
WORD_PRIOR, TAG_PRIOR, CLIP = 0.5, -0.5, 4.0
#: Of words in names: priors, bound of what pages add, share where the name has a word of no list, and the score below
#: which a container is menu-like.
MENU_NAME, ARTICLE_NAME, NAME_CLIP, UNKNOWN, LEAST_NAME = -3.0, 2.5, 2.0, 0.3, -0.25
#: Words of text that count as much as a name's prior.
NAME_SLOWNESS = 200
#: Score of a tag inside a menu-like container.
MENU_TAG = -0.02
#: Why a container is menu-like: by its name, by an element that may also hold a whole page, by what it surely is.
BY_NAME, BY_USE, BY_KIND = 1, 2, 4


@functools.cache
def listed(word: str) -> str:
    """The list entry that a word of a name belongs to, with its list: 'menu:nav*', 'article:post', 'plain:', ''."""
    for e in MENU_WORDS:
        if word == e or (e[-1] == "*" and word.startswith(e[:-1])):
            return f"menu:{e}"
    return f"article:{word}" if word in ARTICLE_WORDS else "plain:" if word in PLAIN_WORDS or word in SAYS or len(word) == 1 else ""


def name_features(names: str, in_article: bool) -> list[tuple[str, float]]:
    """(entry, share) of the words of class and id names that speak for or against a container.

    In a name like ``related-posts`` the menu word decides; with a word of no list (``search-engines``) it counts
    little; after a word that says that something is there (``has-sidebar``) not at all."""
    out = []
    for name in names.split()[:64]:
        words = [w.lower() for w in NAME_WORDS.findall(name)][:16]
        entry = [listed(w) for w in words]
        menu = [k for k, e in enumerate(entry) if e.startswith("menu:") and not (k and words[k - 1] in SAYS)]
        if menu and "menu:header" in entry and (in_article or any(e.startswith("article:") for e in entry)):
            menu = [k for k in menu if entry[k] != "menu:header"]  # an article's own header holds its title
        elif not menu and not any(e.startswith("menu:") for e in entry):
            out += [(e, 1.0) for e in dict.fromkeys(entry) if e.startswith("article:")][:1]
        out += [(entry[k], UNKNOWN if "" in entry else 1.0) for k in menu[:1]]
    return list(dict.fromkeys(out))


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(text):
        out.setdefault(key.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value))
    return out


@functools.lru_cache(maxsize=8192)
def described(name: str, text: str, in_article: bool) -> tuple[int, tuple[tuple[str, float], ...]]:
    """(what marks a container as menu-like whatever its name, the features of its name)."""
    a = attributes(text)
    role = a.get("role", "").lower()
    if name in HARD_MENU or role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
        kind = BY_KIND
    else:
        kind = BY_USE if name in SOFT_MENU or (name == "header" and not in_article) else 0
    if name in ARTICLE | {"body", "html"} or role in ARTICLE:
        return 0 if name in ("body", "html") else kind, ()
    return kind, tuple(name_features(f"{a.get('class', '')} {a.get('id', '')}", in_article))


class Closers:
    """Where the elements that are not read end; each kind is looked for once a page."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def end(self, name: str, start: int, at: int) -> int:
        """The end of the element whose tag stands at ``start`` and ends at ``at``; -1 if it is never closed."""
        if name not in self.found:
            self.found[name] = self._nested(name) if name in NESTED else [(m.start(), m.end()) for m in re.finditer(rf"</{name}(?:\s[^>]*+)?+>", self.page, re.IGNORECASE)]
        if name in NESTED:
            return self.found[name].get(start, -1)
        k = bisect.bisect_left(self.found[name], (at, 0))
        return self.found[name][k][1] if k < len(self.found[name]) else -1

    def _nested(self, name: str) -> dict[int, int]:
        open_, ends = [], {}
        for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*+>", self.page, re.IGNORECASE):
            if m[1]:
                if open_:
                    ends[open_.pop()] = m.end()
            elif not m[0].endswith("/>"):
                open_.append(m.start())
        return ends


def tokens(page: str):
    """('text', text, '', '', 0) and ('tag', '/' or '', name, attributes, start) in page order, without what is not read.

    A tag that never ends is text, as is all after it; a comment that never ends is dropped with what it holds."""
    closers, at, search, cdata = Closers(page), 0, 0, True
    while (lt := page.find("<", search)) >= 0:
        follows, end, tag = page[lt + 1 : lt + 3], -1, None
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2) + 3
            end = len(page) if end < 3 else end
        elif cdata and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt) + 3
            if end < 3:
                cdata = False
                continue
            tag = ("text", page[lt + 9 : end - 3], "", "", lt)
        elif follows[:1] in ("!", "?") or (follows[:1] == "/" and not (follows[1:].isascii() and follows[1:].isalpha())):
            end = page.find(">", lt) + 1
            if not end:
                break
        elif (follows[:1].isascii() and follows[:1].isalpha()) or follows[:1] == "/":
            m = TAG.match(page, lt)
            if not m:
                break
            end, tag = m.end(), ("tag", m[1], m[2].lower(), m[3], lt)
        else:
            search = lt + 1
            continue
        if lt > at:
            yield "text", html.unescape(page[at:lt]), "", "", at
        if tag and not tag[1] and tag[2] in RAW | NESTED and not tag[3].endswith("/"):
            closed = closers.end(tag[2], lt, end)
            end, tag = (closed, None) if closed >= 0 else (end, None)
        if tag:
            yield tag
        at = search = end
    if at < len(page):
        yield "text", html.unescape(page[at:]), "", "", at


class Page:
    """The blocks and tags of a page, each with the containers it stands in."""

    def __init__(self, page: str, names: dict[str, float]):
        #: Per container: its parent, what marks it as menu-like, and the features of its name.
        self.parent, self.own, self.features = [-1], [0], [()]
        #: (kind, key, text, container, whether the page's markup puts it in its article)
        self.found: list[tuple[str, str, str, int, bool]] = []
        wraps = [False]
        stack: list[tuple[str, int]] = [("body", 0)]
        elements, open_ = [""], Counter()
        pieces: list[str] = []
        block, link, linked, articles = "body", 0, 0, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                self.found.append(("block", f"{block}{'/a' if linked else ''}", text, stack[-1][1], articles > 0))
            linked = link

        for kind, what, name, text, _ in tokens(page):
            if kind == "text":
                pieces.append(what)
                linked = linked or (link and bool(what.strip()))
            elif name == "br":
                pieces.append(" ")
            elif name == "a":
                link = 0 if what else 1
            elif name in BLOCK:
                flush()
                if name in CONTAINER and name not in VOID:
                    if what:
                        while open_[name]:
                            ended = stack.pop()[0]
                            open_[ended] -= 1
                            articles -= ended in ARTICLE
                            if ended == name:
                                break
                        link = linked = 0
                    else:
                        own, features = described(name, text, articles > 0)
                        if sum(share * names.get(e, MENU_NAME if e.startswith("menu:") else ARTICLE_NAME) for e, share in features) < LEAST_NAME:
                            own |= BY_NAME
                        self.parent.append(stack[-1][1])
                        self.own.append(own)
                        self.features.append(features)
                        wraps.append(False)
                        elements.append(name)
                        stack.append((name, len(wraps) - 1))
                        open_[name] += 1
                        articles += name in ARTICLE
                if name in ("h1", "main") and not what:
                    c = self.parent[stack[-1][1]] if name == "main" else stack[-1][1]
                    while c >= 0 and not wraps[c]:  # what holds a page's title or main part is no comment and no form field
                        wraps[c] = True
                        c = self.parent[c]
                block = stack[-1][0] if what else name
                self.found.append(("tag", name, "", stack[-1][1], articles > 0))
        flush()
        self.why = [0]
        for c in range(1, len(self.parent)):
            own = self.own[c]
            if wraps[c] and elements[c] != "header" and all(e != "menu:header" for e, _ in self.features[c]):
                own &= BY_KIND
            self.why.append(own | self.why[self.parent[c]])

    def events(self, mask: int = BY_NAME | BY_USE | BY_KIND) -> list[tuple[str, str, str, bool]]:
        """('tag', name, '', inside) and ('block', kind, text, inside); ``mask``: what makes a container menu-like."""
        return [(kind, f"{key}/menu" if self.why[c] & mask else key, text, inside and not self.why[c] & mask) for kind, key, text, c, inside in self.found]


def default_score(kind: str, key: str) -> float:
    if kind == "tag":
        return TAG_PRIOR
    return -2.0 if "/menu" in key else -0.25 if "/a" in key else WORD_PRIOR


def region(found: list, weights: dict[tuple[str, str], float]) -> tuple[int, int]:
    """First and last event of the contiguous region of the largest positive sum (-1, -1: none)."""
    best, span, total, start = 0.0, (-1, -1), 0.0, 0
    for i, (kind, key, text, _) in enumerate(found):
        # what stands in menu-like containers is left out anyway: it must not cut an article in two
        w = (MENU_TAG if kind == "tag" else 0.0) if "/menu" in key else weights.get((kind, key), default_score(kind, key))
        total += w * len(text.split()) if kind == "block" else w
        if total > best:
            best, span = total, (start, i)
        if total <= 0:
            total, start = 0.0, i + 1
    return span


def names_of(weights: dict[tuple[str, str], float]) -> dict[str, float]:
    return {key: w for (kind, key), w in weights.items() if kind == "name"}


def main_text(page: str | None, weights: dict[tuple[str, str], float], names: dict[str, float] | None = None) -> str:
    read = Page(page or "", names_of(weights) if names is None else names)
    for mask in (BY_NAME | BY_USE | BY_KIND, BY_USE | BY_KIND, BY_KIND):
        found = read.events(mask)
        a, b = region(found, weights)
        if b >= 0:
            text = "\n".join(text for kind, key, text, _ in found[a : b + 1] if kind == "block" and "/menu" not in key)
            if text:
                return text
    return ""


def _count(batches):
    counts = defaultdict(lambda: [0, 0])
    for rb in batches:
        for page in rb.column(0).to_pylist():
            read = Page(page or "", {})
            found = read.events()
            if not any(inside for *_, inside in found):
                continue
            for kind, key, text, inside in found:  # a labelled page
                counts[kind, key][not inside] += len(text.split()) if kind == "block" else 1
            above: list[frozenset[str]] = [frozenset()]
            for c in range(1, len(read.parent)):
                up = above[read.parent[c]]
                above.append(up | {e for e, _ in read.features[c]} if read.features[c] else up)
            for kind, _, text, c, inside in read.found:
                if kind == "block":
                    n = len(text.split())
                    for e in (*above[c], ""):
                        counts["name", e][not inside] += n
    rows = [(k, key, a, b) for (k, key), (a, b) in counts.items()]
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "key", "inside", "outside"])


def fit(pages: DataFrame, html_col: str = "html") -> dict[tuple[str, str], float]:
    """Scores of kinds of words and tags and of listed words of names, from all labelled pages; they are few."""
    part = pages.select(F.col(html_col).cast("string")).mapInArrow(_count, "kind string, key string, inside bigint, outside bigint")
    rows = part.groupBy("kind", "key").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).collect()
    weights, odds = {}, lambda a, b: math.log((a + 1) / (b + 1))
    usual = next((odds(a, b) for kind, key, a, b in rows if (kind, key) == ("name", "")), 0.0)
    for kind, key, a, b in rows:
        if kind == "name":
            moved = max(-NAME_CLIP, min(NAME_CLIP, odds(a, b) - usual)) * (a + b) / (a + b + NAME_SLOWNESS)
            if key:
                weights[kind, key] = moved + (MENU_NAME if key.startswith("menu:") else ARTICLE_NAME)
            continue
        w = max(-CLIP, min(CLIP, default_score(kind, key) + odds(a, b)))
        weights[kind, key] = min(-0.05, w) if kind == "tag" else w
    return weights


def _extract(shared):
    def run(batches):
        weights = shared.value
        names = names_of(weights)
        for rb in batches:
            texts = [main_text(p, weights, names) for p in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: dict | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, main text and its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, html_col) if weights is None else weights)
    cols = [F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")]
    return pages.select(*cols).mapInArrow(_extract(shared), "page_id bigint, url string, text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
