"""Main text of web pages by maximum-scoring subsequence.

A page is a line of tokens: runs of words, and tags. Words score positive or negative by
where they stand (innermost block, surrounding region, link or not), tags always negative.
The contiguous region of highest sum, found by one linear scan, is the content; within it
words that score negative (a notice or advert between paragraphs) are left out.

The scores are log odds counted over labelled pages: pages that mark their content with one
``article`` or ``main`` element label each of their own tokens as inside or outside.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many labelled pages are read to learn the scores.
LABELLED_PAGES = 2000
#: So many kinds of token keep a learned score, the commonest first; others take the default.
KINDS = 4000
#: Score of a word under boilerplate. Below 0, so it is left out; small, so an advert between two paragraphs doesn't part them.
BOILERPLATE = -0.1

# Names from the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|select|title"
REGIONS = frozenset("article main nav header footer aside form section dialog menu head".split())
NEVER = frozenset("nav header footer aside form dialog menu head button".split())
#: Elements that a name can make boilerplate: text blocks such as quotations are the article's own, whatever they are called.
NAMED = frozenset("div section ul ol dl p".split())
#: Names that speak against a weak mark of boilerplate on the same element, and such marks.
CONTENT = frozenset("article content entry main post story body text main-content article-body article-content post-content post-body entry-content story-body".split())
WEAK = frozenset("alert banner foot head header notice notices related search share sharing side social tags widget".split())
#: Names in class, id or role that mark boilerplate. These rules hold against learned scores: a labelled page counts the adverts in its article as inside.
NAMES = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|replies|respond|consent|cookies?\w*|gdpr|disqus|footer|foot|header|masthead|menu\w*|nav\w*|newsletter|notices?|pagination|pager|popup|modal|promo\w*|recommend\w*|related|share|sharing|shoutbox|sidebar\w*|side|social\w*|sponsor\w*|subscribe|tags|toolbar|widget\w*|alert|complementary|contentinfo|navigation|search)(?![a-z])",
    re.I,
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _named_bad(name: str, attributes: str) -> bool:
    """Do class, id or role mark the element as boilerplate?"""
    if name not in NAMED:
        return False
    said = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower()
    marks = [m[0] for m in NAMES.finditer(said)]
    return bool(marks) and not (all(m in WEAK for m in marks) and CONTENT.intersection(said.split()))


def _wide_forms(found: list[re.Match]) -> set[int]:
    """Places of forms that wrap the page: they hold an ``article`` or ``main``, or half of all words."""
    forms, at, total = [], None, 0  # place, words, holds the article
    for i, m in enumerate(found):
        if m[0][0] != "<" or m[0] == "<":
            total += len(m[0].split())
            continue
        name = (m[3] or m[6] or "").lower()
        if name == "form":
            if at is not None:
                forms.append((at[0], total - at[1], at[2]))
            at = None if m[2] or m[5] else [i, total, False]
        elif at is not None and name in ("article", "main"):
            at[2] = True
    if at is not None:
        forms.append((at[0], total - at[1], at[2]))
    return {i for i, words, holds in forms if holds or 2 * words >= total > 0}


class _Open:
    """The open elements, with counts that spare a look through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool]] = []
        self.regions = ["body"]
        self.count: Counter = Counter()
        self.bad = 0

    def push(self, name: str, bad: bool) -> None:
        self.stack.append((name, bad))
        self.count[name] += 1
        self.bad += bad
        if name in REGIONS:
            self.regions.append(name)

    def pop(self) -> str:
        name, bad = self.stack.pop()
        self.count[name] -= 1
        self.bad -= bad
        if name in REGIONS:
            self.regions.pop()
        return name

    @property
    def inside(self) -> bool:
        return self.count["article"] + self.count["main"] > 0


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, text, breaks, inside): text is empty for a tag; breaks: a block begins or ends here.

    The kind of text is ``block/region``, with ``@a`` in a link and ``!`` under boilerplate;
    inside: an open ``article`` or ``main`` holds it. Takes time in proportion to the page,
    however deep it nests.
    """
    found = list(_TOKEN.finditer(page))
    wide, now, links = _wide_forms(found), _Open(), 0
    for i, m in enumerate(found):
        token = m[0]
        if token[0] != "<" or token == "<":
            block = now.stack[-1][0] if now.stack else "body"
            yield f"{block}/{now.regions[-1]}{'@a' if links else ''}{'!' if now.bad else ''}", token, False, now.inside
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            yield "<raw>", "", False, False
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        inside = now.inside
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            yield f"<{name}>", "", False, inside
            continue
        if closing:
            if now.count[name]:
                while now.pop() != name:
                    pass
            links = 0
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("article", "main", "body"):  # what was left open before doesn't hold the content
                while now.stack and now.stack[-1][1]:
                    now.pop()
            if now.stack and now.stack[-1][0] == "p":
                now.pop()
            now.push("div" if i in wide else name, i not in wide and (name in NEVER or name not in ("html", "body", "article", "main") and _named_bad(name, attributes)))
            links = 0
        yield f"<{'/' if closing else ''}{name}>", "", True, inside


def default_score(kind: str) -> float:
    """Of a kind that no labelled page has shown often enough."""
    if kind[0] == "<":
        return -0.1 if kind[1:-1] in INLINE else -0.5
    return BOILERPLATE if kind.endswith("!") else 0.2 if "@a" in kind else 1.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the highest sum; the first longest of equals; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best region: blocks in page order, joined by one space."""
    if not page:
        return ""
    found = list(tokens(page))
    each = [weights[k] if k in weights else default_score(k) for k, *_ in found]
    start, end = best_region([w * len(t.split()) if t else w for w, (_, t, _, _) in zip(each, found, strict=True)])
    blocks, now = [], []
    for w, (kind, text, breaks, _) in zip(each[start:end], found[start:end], strict=True):
        if text:
            if w > 0:
                now.append(html.unescape(text))
        elif breaks or kind == "<br>":
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def learn_weights(pages: DataFrame, html_col: str = "html", key: Column | None = None, labelled: int = LABELLED_PAGES) -> dict[str, float]:
    """Scores by kind of token, from about ``labelled`` pages with exactly one marked content element.

    The pages are picked by a hash of the whole row's html (or ``key``), so the sample stays
    the same in any layout; what comes to the driver is one row for each of ``KINDS`` kinds.
    """
    marked = pages.where(F.regexp_count(html_col, F.lit("(?i)<(?:article|main)[ >]")) == 1)
    share = labelled / max(1, pages.count())
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64(key if key is not None else F.col(html_col)), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch["html"]:
                for kind, text, _, inside in tokens(page):
                    seen[kind, inside] += len(text.split()) if text else 1
        if rows := [(k, i, n) for (k, i), n in seen.items() if n]:
            yield pd.DataFrame(rows, columns=["kind", "inside", "n"])

    counts = (
        marked.select(F.col(html_col).cast("string").alias("html"))
        .mapInPandas(count, "kind string, inside boolean, n long")
        .groupBy("kind")
        .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("ins"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outs"))
        .where(F.col("ins") + F.col("outs") >= 20)
        .orderBy(F.desc(F.col("ins") + F.col("outs")), "kind")
        .limit(KINDS)
        .collect()
    )
    weights = {}
    for kind, ins, outs in counts:
        odds = math.log((ins + 0.5) / (outs + 0.5))
        # a kind under boilerplate stays out even where it was nested in the marked element
        weights[kind] = min(-0.25, max(-3.0, odds)) if kind[0] == "<" else BOILERPLATE if kind.endswith("!") else min(1.0, max(-3.0, odds))
    return weights


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with their main text in ``text_col`` (replaced if there).

    Null and empty pages, and pages without a positive region, give an empty text. Repeated
    rows are treated alike, other columns pass unchanged, an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def main(source: pd.Series) -> pd.Series:
        return source.map(lambda x: main_text(x, weights))

    return pages.withColumn(text_col, main(F.col(html_col).cast("string")))
