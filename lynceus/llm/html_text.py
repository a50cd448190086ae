"""Main text of web pages as a maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive and tags negative, by log-odds learned from pages whose
markup shows where their article is; the run with the largest sum, found in one linear scan, is the content. Elements
that are never content (scripts, menus, adverts, comments and the like) stand in the sequence as one tag each.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration or a tag with its name and attributes.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: Elements that are never content.
NEVER = frozenset("nav aside footer form menu dialog select button svg canvas object audio video head".split()) | RAW
#: Words of class, id, role or label that mark an element as no content.
NO_CONTENT = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus dialog footer form masthead menu modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promoted promotion related respond search share sharing sidebar skip social sponsor "
    "sponsored subscribe toolbar widget".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class PageModel:
    """Score of each kind of token; kinds that were not met score as ``word`` or ``tag``."""

    word: float = 1.0
    tag: float = -3.0
    scores: dict[str, float] = field(default_factory=dict)

    def of(self, kind: str) -> float:
        return self.scores.get(kind, self.word if kind.startswith("word:") else self.tag)


def _not_content(name: str, attributes: str, in_article: bool) -> bool:
    if name in NEVER or (name == "header" and not in_article):
        return True
    if name in ("html", "body") or not attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower()))
            if words & NO_CONTENT and not (name in ARTICLE and key != "role"):
                return True
        elif key == "aria-hidden" and "".join(values).lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", attributes, re.I))


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, inside an article) per token. Text comes in pieces; kind ``tag:name`` or ``word:context``."""
    at, skip, depth, article, links, items, heads = 0, "", 0, 0, 0, 0, 0
    length = len(page)

    def context() -> str:
        return "word:" + ("link" if links > 0 else "item" if items > 0 else "heading" if heads > 0 else "text")

    for m in iter(lambda: MARKUP.search(page, at), None):
        if not skip and m.start() > at:
            yield context(), page[at:m.start()], article > 0
        at = m.end()
        close, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if skip:  # only the element that began it counts
            if name == skip and not attributes.endswith("/"):
                depth += -1 if close else 1
                if not depth:
                    skip = ""
            if not close and name in RAW:
                at = _raw_end(page, at, name)
                if name == skip:
                    depth -= 1
                    if not depth:
                        skip = ""
            continue
        if not close and name in RAW:
            at = _raw_end(page, at, name)
            yield f"tag:{name}", "", article > 0
            continue
        if not close and name not in VOID and not attributes.endswith("/") and _not_content(name, attributes, article > 0):
            yield "tag:skipped", "", article > 0
            if name not in ("p", "li"):  # these may be left open
                skip, depth = name, 1
                continue
        step = -1 if close else 1
        if name in ARTICLE:
            article = max(0, article + step)
        elif name == "a":
            links = max(0, links + step)
        elif name in ("ul", "ol", "dl"):
            items = max(0, items + step)
        elif name in HEADINGS:
            heads = max(0, heads + step)
        yield f"tag:{name}", "", article > 0
    if not skip and at < length:
        yield context(), page[at:], article > 0


def _raw_end(page: str, at: int, name: str) -> int:
    """End of the element whose raw content begins at ``at``."""
    m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


def main_text(page: str, model: PageModel) -> str:
    """Text of the best run: blocks in page order, white space turned into single spaces, character references decoded."""
    parts, inside, total, best, start, span = [], [], 0.0, 0.0, 0, (0, 0)
    for kind, text, in_article in tokens(page):
        parts.append((kind, text))
        inside.append(in_article)
        if kind.startswith("tag:"):
            score = model.of(kind)
        elif words := len(text.split()):
            score = words * model.of(kind)
        else:
            continue
        if total <= 0:
            total, start = 0.0, len(parts) - 1
        total += score
        if total > best:
            best, span = total, (start, len(parts))
    first, last = span  # a run that begins or ends inside a marked article takes in the rest of it
    while last > 0 and first > 0 and inside[first] and inside[first - 1]:
        first -= 1
    while 0 < last < len(parts) and inside[last - 1] and inside[last]:
        last += 1
    out = []
    for kind, text in parts[first:last]:
        out.append(html.unescape(text) if text else "" if kind[4:] in INLINE else " ")
    return " ".join("".join(out).split())


def learn(pages: list[str]) -> PageModel:
    """Log-odds of each kind of token inside and outside of the article, of pages that mark one.

    Words never score below 0.1 and tags never above -0.1, so sums keep the sense of the method. Without such pages the
    default scores hold.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        found = [(kind, max(1, len(text.split())) if text else 1, a) for kind, text, a in tokens(page)
                 if not text or text.strip()]
        if any(a for _, _, a in found):
            for kind, n, a in found:
                (inside if a else outside)[kind] += n
    if not inside:
        return PageModel()
    n_in, n_out = sum(inside.values()), sum(outside.values())
    scores = {}
    for kind in inside.keys() | outside.keys():
        odds = math.log((inside[kind] + 0.5) / (n_in + 1)) - math.log((outside[kind] + 0.5) / (n_out + 1))
        scores[kind] = max(0.1, odds) if kind.startswith("word:") else min(-0.1, odds)
    return PageModel(max(0.1, scores.get("word:text", 1.0)), -3.0, scores)


def fit(pages: DataFrame, page: str = "html", key: str = "page_id", max_pages: int = 400,
        max_chars: int = 200_000) -> PageModel:
    """Scores from a bounded sample: the ``max_pages`` pages of the smallest key hash that mark an article."""
    marked = pages.where(F.col(page).rlike("(?i)<(article|main)[ >]") & (F.length(page) <= max_chars)).select(
        F.col(page).alias("page"), F.xxhash64(key).alias("h"))
    least = [r[0] for r in marked.select("h").orderBy("h").limit(max_pages).collect()]
    if not least:
        return PageModel()
    return learn([r[0] for r in marked.where(F.col("h") <= least[-1]).limit(2 * max_pages).orderBy("h", "page").collect()])


def page_text(page: Column, model: PageModel) -> Column:
    """Main text of each page; null and empty pages have the empty text. Rows are read whole and by themselves."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, model) if x else "" for x in pages], dtype=object)

    return extract(page)


def op5(pages: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``pages``."""
    return (pages.select("page_id", "url", page_text(F.col("html"), fit(pages)).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
