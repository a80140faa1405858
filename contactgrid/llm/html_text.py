"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a line of tokens: words, and tags that cut it into blocks.  Tags score negative;
words score by what is seen of their block: the elements, roles and words in class or id of its
containers, its own element, its length, its links and how it ends.  The weights are log odds fitted on
labelled pages, those that mark their own article, which mark itself is hidden from the fit; a prior
stands for what those pages don't show.  One linear scan finds all maximal-scoring stretches.  The best
is the text; if it lies in a marked article, so are the others that do, without what lies between.
Blocks in containers whose odds tell of menus, forms, adverts, comments and the like are left out.

Where a page marks an article that holds a fair share of what scores, to lie in it is one more feature of a
block, bounded like the others; what scores below zero then is left out of a stretch.  Words in class or id
don't count against an article, and against what holds one or has most of the page's words only where nothing
else were left; a form that holds either is the page's frame.

All work is linear in the page: tags are matched in one pass, containers know their parent alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Fixed values of HTML: elements whose content is raw, that have no content, and that make no block.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "select", "datalist", "annotation", "annotation-xml", "desc", "metadata"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "noscript", "object", "canvas", "math", "svg", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
#: Elements whose tags cut nothing, and none of those inside them does.
WHOLE = frozenset(("math", "svg"))
#: Elements and roles, and words in class or id, whose content is no article text.
OUTSIDE = frozenset(("nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "head", "header"))
OUTSIDE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"))
OUTSIDE_WORDS = frozenset(("ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"))
#: The same where no article is open, as for the element header.
HEADER_WORDS = frozenset(("header", "topbar", "masthead"))
#: Words in class or id that mark an article, besides the element, the role and the property.
ARTICLE_WORDS = frozenset(("article", "post", "entry", "story"))
ARTICLE_PARTS = frozenset(("body", "content", "text", "main"))
#: Start tags that end an open p, and tags of lists that end their own kind.
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
#: White space of HTML and the no-break space, which the page shows as one.
_SPACE = re.compile(r"\s+")
#: Class names that deny what follows, and companions without which a share is no button.
_DENIED = re.compile(r"(?:no|has|with|without|hide|non)-", re.I)
_SHARING = frozenset(("share", "sharing", "social", "button", "buttons", "link", "links", "bar", "icon", "icons", "tools", "this", "post", "page", "box", "widget", "list", "menu", "container", "wrapper"))


#: Odds before any page is seen, by kind of feature; a feature that no page shows keeps them, others 0.
OUT_ELEMENT, OUT_WORD, ARTICLE_WORD = -4.0, -3.0, 1.0
PRIOR = {
    **{f"el:{x}": OUT_ELEMENT for x in OUTSIDE},
    **{f"role:{x}": OUT_ELEMENT for x in OUTSIDE_ROLES},
    **{f"class:{x}": OUT_WORD for x in OUTSIDE_WORDS | HEADER_WORDS},
    **{f"class:{x}": ARTICLE_WORD for x in ARTICLE_WORDS | ARTICLE_PARTS},
    **{f"own:{x}": 0.5 for x in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "figcaption")},
    **{"link:none": 0.5, "link:some": 0.0, "link:most": -2.0, "words:20+": 0.8, "words:5+": 0.2, "words:1+": -0.3, "end:stop": 0.4, "end:none": -0.2},
    **{"tag:p": -0.2, "tag:other": -1.0, "mark:in": 2.0, "mark:out": -2.0},
}
#: A container whose odds are this low is left out; learned words without a prior can't do that alone.
DROP, UNKNOWN = -1.0, 0.9
#: What features of a block itself can add or take, by kind.
OWN = {"own": 1.0, "link": 2.0, "words": 0.5, "end": 0.25, "mark": 2.0}
#: The share of the words that score without an article's mark which marked ones must hold for it to count.
CREDIBLE = 1 / 3
#: Elements and roles that frame a whole page as well.
FRAMES = frozenset(("el:form", "el:fieldset", "role:form"))
#: The share of all words that a prior weighs as much as.
STRENGTH = 0.02


@dataclass
class Container:
    """strict: features of its element and role; loose: words in class or id.  mark: 2 of an article, 1 of
    the page's main part; path_mark is the most of it and those around it.  words and holds (an article inside)
    are known when all is read; fresh: features that none around it has."""

    name: str
    strict: tuple[str, ...] = ()
    loose: tuple[str, ...] = ()
    hidden: bool = False
    mark: int = 0
    words: int = 0
    holds: bool = False
    parent: Container | None = None
    path_mark: int = 0
    fresh: tuple[str, ...] = ()


@dataclass
class Block:
    text: str
    own: tuple[str, ...]
    tags: Counter
    inside: Container | None
    n_words: int = 0

    def mark(self) -> int:
        return self.inside.path_mark if self.inside else 0


def _container(name: str, attributes: str, in_article: bool) -> Container:
    """A header inside an article is its heading."""
    strict = (f"el:{name}",) if name in OUTSIDE and not (name == "header" and in_article) else ()
    mark = 2 if name == "article" else int(name == "main")
    if not attributes.strip():
        return Container(name, strict, mark=mark)
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    strict += (f"role:{role}",) if role in OUTSIDE_ROLES else ()
    hidden = found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", ""))) or bool(_BARE_HIDDEN.search(_ATTRIBUTE.sub(" ", attributes)))
    names = [{w.lower() for w in _WORDS.findall(_HUMP.sub(r"\1 \2", x))} for k in ("class", "id") for x in found.get(k, "").split() if not _DENIED.match(x)]
    names = [w - {"share"} if "share" in w and w - _SHARING else w for w in names]
    page = name in ("html", "body")
    other = lambda words: words & OUTSIDE_WORDS or words & HEADER_WORDS and not in_article
    words = set().union(*(x for x in names if not other(x)))
    marked = words & ARTICLE_WORDS and ("article" in words or words & ARTICLE_PARTS) and not page
    if marked or role == "article" or found.get("itemprop") == "articleBody":
        mark = 2
    loose = () if page else tuple(sorted(f"class:{w}" for w in set().union(*names) if not (w in HEADER_WORDS and in_article)))
    return Container(name, strict, loose, hidden, max(mark, int(role == "main")))


@dataclass
class Tag:
    start: int
    end: int
    name: str
    closing: bool
    attributes: str
    #: Of inline elements, the place of the tag that ends them; of others -1.
    ends_at: int = -1


def _tags(page: str) -> tuple[list[Tag], list[int], list[int]]:
    """The tags of a page but for raw content, and how many words and articles are before each and in all."""
    out: list[Tag] = []
    words, articles = [0], [0]
    open_at: dict[str, list[int]] = {}
    at, last = 0, 0
    while m := _TAG.search(page, at):
        name = (m[2] or "").lower()
        at = m.end()
        if name in RAW and not m[1] and not m[3].endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        words.append(words[-1] + len(page[last : m.start()].split()))
        articles.append(articles[-1] + (name == "article" and not m[1]))
        last = at
        tag = Tag(m.start(), at, "" if name in RAW else name, bool(m[1]), m[3] or "")
        if name in INLINE and name not in VOID:
            if not m[1]:
                if not m[3].endswith("/"):
                    open_at.setdefault(name, []).append(len(out))
            elif open_at.get(name):
                out[open_at[name].pop()].ends_at = len(out)
        out.append(tag)
    words.append(words[-1] + len(page[last:].split()))
    return out, words, articles


def blocks(page: str) -> tuple[list[Block], list[Container]]:
    """The blocks of a page with a word and its containers, in page order.  Inline elements that are hidden, or
    whose role or class tells of no text, are passed over to their own end, so that the block around them stays
    one; but not what holds an article or most of the page's words."""
    out: list[Block] = []
    made: list[Container] = []
    text: list[str] = []
    tags: Counter = Counter()
    stack: list[Container] = []
    names: Counter = Counter()
    seen: Counter = Counter()
    linked = marks = whole = 0
    link = False
    found, words, articles = _tags(page)

    def end() -> None:
        nonlocal tags, linked
        got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if got:
            size = got.count(" ") + 1
            share = linked / len(got)
            own = (f"own:{stack[-1].name if stack else 'body'}", f"link:{'most' if share > 0.5 else 'some' if linked else 'none'}", f"words:{'20+' if size >= 20 else '5+' if size >= 5 else '1+'}", f"end:{'stop' if got[-1] in '.!?\"”»:' else 'none'}")
            out.append(Block(got, own, tags, stack[-1] if stack else None, size))
            if stack:
                stack[-1].words += size
            tags = Counter()
        text.clear()
        linked = 0

    def push(c: Container) -> None:
        nonlocal marks
        c.parent = stack[-1] if stack else None
        c.path_mark = max(c.mark, c.parent.path_mark if c.parent else 0)
        if c.mark == 2:
            x = c.parent
            while x and not x.holds:
                x.holds, x = True, x.parent
        own = (*c.strict, *c.loose)
        c.fresh = tuple(f for f in own if not seen[f])
        seen.update(own)
        names[c.name] += 1
        marks += bool(c.mark)
        stack.append(c)
        made.append(c)

    def pop() -> Container:
        nonlocal marks
        c = stack.pop()
        seen.subtract((*c.strict, *c.loose))
        names[c.name] -= 1
        marks -= bool(c.mark)
        if c.parent:
            c.parent.words += c.words
        return c

    k = at = 0
    while k < len(found):
        tag = found[k]
        if tag.start > at:
            text.append(page[at : tag.start])
            linked += (tag.start - at) * link
        at, name = tag.end, tag.name
        k += 1
        if name in WHOLE:
            whole = max(0, whole + (-1 if tag.closing else not tag.attributes.endswith("/")))
        if not name or whole and name not in CLOSES_P:
            continue
        whole = 0  # what can't be inside ends it
        if name in INLINE:
            if name == "a":
                link = not tag.closing
            if not tag.closing and name not in VOID and tag.attributes.strip():
                c = _container(name, tag.attributes, bool(marks))
                off = c.hidden or bool(c.strict)
                if off or not c.mark and any(PRIOR.get(f, 0) <= DROP for f in c.loose):
                    stop = tag.ends_at if tag.ends_at >= 0 else len(found)
                    if not off:
                        before = words[min(stop, len(found)) + 1] - words[k]
                        off = articles[stop] == articles[k] and 2 * before <= words[-1]
                    if off:
                        at = found[stop].end if stop < len(found) else len(page)
                        k = min(stop + 1, len(found))
            continue
        if name == "br":
            text.append(" ")
            continue
        end()
        tags["p" if name == "p" else "other"] += 1
        if tag.closing:
            if names[name]:
                while pop().name != name:
                    pass
        elif name not in VOID:
            if name in CLOSES_P and stack and stack[-1].name == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].name == name:
                pop()
            push(_container(name, tag.attributes, bool(marks)))
    if at < len(page):
        text.append(page[at:])
        linked += (len(page) - at) * link
    end()
    while stack:
        pop()
    return out, made


class Weights:
    """Odds by feature; what none is known of weighs nothing."""

    def __init__(self, odds: dict[str, float] = PRIOR):
        self.odds = odds

    def container(self, c: Container, n_words: int, waive: int) -> float:
        """Below zero: the lower, the less its content is article text.  waive: whether words in class or id
        of what holds an article (1), and of what has most words (2), don't count."""
        if c.hidden:
            return -math.inf
        frame = c.holds or 2 * c.words > n_words
        strict = sum(min(0.0, self.odds.get(f, 0.0)) for f in c.strict if not (frame and f in FRAMES))
        if not c.loose or c.mark == 2 or waive and c.holds or waive > 1 and 2 * c.words > n_words:
            return strict
        known = [self.odds.get(f, 0.0) for f in c.loose if f in PRIOR]
        new = sum(self.odds.get(f, 0.0) for f in c.loose if f not in PRIOR)
        loose = min((w for w in known if w < 0), default=0.0) + sum(w for w in known if w > 0)
        return strict + min(0.0, loose + max(-UNKNOWN, min(UNKNOWN, new)))

    def own(self, features: tuple[str, ...]) -> float:
        """Of a block's own features."""
        most = [OWN[f.partition(":")[0]] for f in features]
        return sum(max(-m, min(m, self.odds.get(f, 0.0))) for f, m in zip(features, most, strict=True))


def _around(found: list[Block], made: list[Container], weights: Weights) -> list[float]:
    """The odds of each block's worst container.  Words in class or id are waived only as far as it takes
    for a marked article to be text; of a page without one, as far as can be."""
    n_words, marked = sum(b.n_words for b in found), any(b.mark() == 2 for b in found)
    out: list[float] = []
    for waive in range(3) if marked else (2,):
        worst: dict[int, float] = {}
        for c in made:  # parents come first
            worst[id(c)] = min(weights.container(c, n_words, waive), worst[id(c.parent)] if c.parent else 0.0)
        out = [worst[id(b.inside)] if b.inside else 0.0 for b in found]
        if any(b.mark() == 2 and w > DROP for b, w in zip(found, out, strict=True)):
            break
    return out


def _scores(found: list[Block], around: list[float], weights: Weights) -> tuple[list[float], int]:
    """Two scores a block, of the tags before it and of its words, and the level of the page's mark."""
    per_word = [weights.own(b.own) + max(a, -4.0) for b, a in zip(found, around, strict=True)]
    gain = [b.n_words * max(0.0, w) for b, w in zip(found, per_word, strict=True)]
    level = 0
    for mark in (2, 1):
        marked = sum(g for g, b, a in zip(gain, found, around, strict=True) if b.mark() >= mark and a > DROP)
        if not level and marked and marked >= CREDIBLE * sum(gain):
            level = mark
    out = []
    for b, w, a in zip(found, per_word, around, strict=True):
        tags = sum(k * min(0.0, weights.odds.get(f"tag:{t}", 0.0)) for t, k in b.tags.items())
        if level:
            w += weights.own(("mark:in" if b.mark() >= level and a > DROP else "mark:out",))
        out += [tags, b.n_words * w]
    return out, level


def stretches(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring stretches [from, to) with their sums, in order: each is the best that doesn't
    reach into another, and the highest of them is the best of all.  One scan; each kept stretch knows
    the last one before it whose running sum was lower at its start."""
    kept: list[tuple[int, int, float, float, int]] = []  # from, to, running sum before and behind, that one
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        lo, left, at = k, before, len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= left:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= total:
                break
            lo, left = kept[at][0], kept[at][2]
            at = kept[at][4]
            # everything from that stretch on is one
        while kept and kept[-1][0] >= lo:
            kept.pop()
        kept.append((lo, k + 1, left, total, at))
    return [(lo, hi, right - left) for lo, hi, left, right, _ in kept]


def main_text(page: str, weights: Weights | None = None) -> str:
    """The blocks of the best stretch and, if a marked article scores in it, of all others where one does; where
    the mark counts, only blocks that score themselves."""
    weights = weights or Weights()
    found, made = blocks(page)
    around = _around(found, made, weights)
    scores, level = _scores(found, around, weights)
    all_of = stretches(scores)
    if not all_of:
        return ""

    def marked(s: tuple[int, int, float]) -> bool:
        return any(found[k // 2].mark() >= level and scores[k] > 0 for k in range(s[0], s[1]) if k % 2)

    best = max(all_of, key=lambda s: (s[2], -s[0]))
    chosen = [s for s in all_of if s == best or level and marked(best) and marked(s)]
    inside = {k // 2 for lo, hi, _ in chosen for k in range(lo, hi) if k % 2 and (scores[k] > 0 or not level)}
    return "\n\n".join(b.text for k, (b, a) in enumerate(zip(found, around, strict=True)) if k in inside and a > DROP)


def counts(page: str) -> Counter:
    """For the fit: words by feature and by whether the page's article holds them.  Pages that mark no
    article count nothing; the mark itself is no feature."""
    (found, made), out = blocks(page), Counter()
    if not any(b.mark() == 2 for b in found):
        return out
    sums = {id(c): [0, 0] for c in made}
    for b, a in zip(found, _around(found, made, Weights()), strict=True):
        inside = b.mark() == 2 and a > DROP
        out.update({(f, inside): b.n_words for f in (*b.own, "word")})
        for t, k in b.tags.items():
            out[f"tag:{t}", inside] += k
        if b.inside:
            sums[id(b.inside)][inside] += b.n_words
    for c in reversed(made):  # children come first
        for inside, n in enumerate(sums[id(c)]):
            if c.parent:
                sums[id(c.parent)][inside] += n
            if n:
                out.update({(f, bool(inside)): n for f in set(c.fresh)})
    return out


def fit(seen: Counter) -> dict[str, float]:
    """Log odds of a word of the article against another to be seen with a feature; the prior weighs as
    much as STRENGTH of the words.  Tags cost as many words as the share of them outside, a twentieth
    at least."""
    total = {side: seen["word", side] for side in (True, False)}
    if not all(total.values()):
        return dict(PRIOR)
    out = {}
    for f in set(PRIOR) | {f for f, _ in seen if f != "word"}:
        if f.startswith("mark:"):
            out[f] = PRIOR[f]  # hidden from the fit
            continue
        prior, of = PRIOR.get(f, 0.0), [seen[f, side] for side in (True, False)]
        if f.startswith("tag:"):
            out[f] = -max(0.05, (of[1] + 1) / (of[0] + of[1] + 2)) if any(of) else prior
        else:
            share = 1 / (1 + math.exp(-prior))
            rates = [n / total[side] + STRENGTH * x for n, side, x in zip(of, (True, False), (share, 1 - share), strict=True)]
            out[f] = math.log(rates[0] / rates[1])
    return out


def fitted(pages: DataFrame, rows: int, id_col: str, html_col: str) -> Weights:
    """The weights from at most `rows` pages, drawn by a hash of the id.  Features that fewer than three
    of those pages show are left out, so what comes to the driver is bounded by the sample."""
    some = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(rows)
    sample = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(some), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            total, on = Counter(), Counter()
            for page in b.column(1).to_pylist():
                got = counts(page or "")
                total.update(got)
                on.update(got.keys())
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64()), pa.array([on[k] for k in keys], pa.int64())], names=["feature", "inside", "n", "pages"])

    sums = sample.mapInArrow(run, "feature string, inside boolean, n long, pages long").groupBy("feature", "inside").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    return Weights(fit(Counter({(r.feature, r.inside): r.n for r in sums.where("pages > 2").collect()})))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows: int = 1000) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    `rows` bounds the pages the weights are fitted on.  A null or empty page, or one without a word
    that scores, has an empty text.  Pages cut short end where they are cut.  Repeated rows come out
    repeatedly; other columns are ignored; an empty table gives an empty one."""
    weights = fitted(pages, rows, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            texts = [main_text(p or "", weights) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
