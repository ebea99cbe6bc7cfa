"""Main text of web pages by a maximum-scoring contiguous run of tokens.

A page is a sequence of words and tags. Words score above zero and tags below; how much depends on what they are (a
word in a link counts less than a plain one, a list tag costs more than a line break) and is learned as log-odds from
labelled pages, which a seeded writer in this file makes. One linear scan finds the run with the highest sum. The
deepest element that holds all words of that run, elements left out not counting, is the content region, and its text, without the elements
that are never article text (scripts, menus, forms, adverts, comments, ...), is the result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import table
from termforge.llm.tokens import small_batches

#: Labelled pages to learn from.
PAGES = 400
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("nav footer aside form button select option dialog menu object canvas audio video fieldset head".split())
_NOT_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar"
    r"|comments?|respond|replies|disqus|share|sharing|social|related|recommended|popup|modal|overlay|skip-link|toolbar|widget|pagination|pager|search)(?:$|[\s_-])",
    re.I,
)
#: Elements whose class, role or label may say that they are not article text; an id says so only as a whole, since
#: headings and sections have ids made of their words.
_NAMED_PARTS = frozenset("div section ul ol dl table td tr center header footer figure iframe details main span".split())
_ENDED = ("head", "nav", "form", "title")
_HOLDERS = frozenset("html body main article section div td center".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _named_so(name: str, attributes: str) -> bool:
    """Whether its names say that an element is not article text."""
    for key, *values in _NAMED.findall(attributes):
        for v in filter(None, values):
            if key.lower() != "id":
                if _NOT_TEXT.search(v):
                    return True
            elif all(_NOT_TEXT.fullmatch(w) for w in re.split(r"[\s_-]+", v) if w):
                return True
    return False


class _Element:
    __slots__ = ("name", "first", "last", "parent", "out")

    def __init__(self, name: str, first: int, parent: int, out: bool) -> None:
        self.name, self.first, self.last, self.parent, self.out = name, first, -1, parent, out


def parsed(page: str) -> tuple[list[tuple[str, str, int]], list[_Element]]:
    """Tokens (kind, text, element) in page order, and elements with the numbers of their first and last token.

    kind is "w" for text, "wa" for text in a link, or the name of a tag. An element whose end is missing lasts as long
    as what it stands in; but one that would be left out is then taken as not begun, except in the head.
    """
    tokens: list[tuple[str, str, int]] = []
    elements = [_Element("", 0, -1, False)]
    stack, opened = [0], Counter()
    links = 0

    def text(raw: str) -> None:
        if raw:
            tokens.append(("wa" if links else "w", raw, stack[-1]))

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            e = elements[stack.pop()]
            e.last = len(tokens)
            opened[e.name] -= 1
            links -= e.name == "a"

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            tokens.append((name, "" if name in _INLINE else " ", stack[-1]))
            if opened[name] > 0:  # what is looked through is closed, so a page costs its length
                i = len(stack) - 1
                while elements[stack[i]].name != name:
                    i -= 1
                close(i)
            continue
        if name in _CLOSES_P and elements[stack[-1]].name == "p" or name == "li" and elements[stack[-1]].name == "li":
            close(len(stack) - 1)
        if name == "body" or name in ("article", "main"):
            while any(opened[x] > 0 for x in _ENDED):  # a head or menu that was left open ends here
                close(len(stack) - 1)
        tokens.append((name, "" if name in _INLINE else " ", stack[-1]))
        if name in _VOID or m[4].endswith("/"):
            continue
        inside = opened["article"] > 0 or opened["main"] > 0
        out = name in _NEVER or name == "header" and not inside
        if not out and m[4] and name in _NAMED_PARTS:
            out = _named_so(name, m[4])
        elements.append(_Element(name, len(tokens), stack[-1], out))
        opened[name] += 1
        links += name == "a"
        stack.append(len(elements) - 1)
    text(page[at:])
    for i in stack[1:]:
        if elements[i].name not in ("head",):
            elements[i].out = False
    close(0)
    return tokens, elements


def _left_out(tokens: list, elements: list[_Element]) -> list[bool]:
    """For each element whether it or what it stands in is left out."""
    out: list[bool] = []
    for e in elements:
        out.append(e.out or (e.parent >= 0 and out[e.parent]))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum, the longest of the first such: one linear scan."""
    best = total = 0.0
    start = first = last = 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return first, last


class Extractor:
    """Learned scores of words and tags."""

    def __init__(self) -> None:
        yes, no = Counter(), Counter()
        for page, content in labelled_pages():
            tokens, elements = parsed(page)
            out = _left_out(tokens, elements)
            inside = [False] * len(elements)
            for i, e in enumerate(elements):
                inside[i] = (e.parent >= 0 and inside[e.parent]) or content in (e.name, f"{e.name}") or (content == "div" and e.name == "div" and not out[i] and e.parent >= 0 and elements[e.parent].name == "body" and e.last - e.first > 12)
            for kind, raw, at in tokens:
                (yes if inside[at] and not out[at] else no)[kind] += len(raw.split()) if kind in ("w", "wa") else 1
        n, m = sum(yes.values()), sum(no.values())
        self.scores: dict[str, float] = {}
        for kind in {*yes, *no}:
            odds = math.log((yes[kind] + 1) / (n + 1)) - math.log((no[kind] + 1) / (m + 1))
            self.scores[kind] = max(0.05, odds) if kind in ("w", "wa") else min(-0.5, odds)

    def region(self, tokens: list, elements: list[_Element], out: list[bool]) -> int:
        """The smallest element that holds all words of the best run."""
        words = [len(raw.split()) if kind in ("w", "wa") and not out[at] else 0 for kind, raw, at in tokens]
        scores = [self.scores["w" if kind == "w" else "wa"] * n if kind in ("w", "wa") else 0.0 if out[at] else self.scores.get(kind, -1.0) for (kind, _, at), n in zip(tokens, words)]
        first, last = best_run(scores)
        total = [0]
        for n in words:
            total.append(total[-1] + n)
        need = total[last] - total[first]
        best = 0
        for i, e in enumerate(elements):  # parents come before what they hold
            if e.name in _HOLDERS and not out[i] and need > 0:
                a, b = max(first, e.first), min(last, e.last)
                if b > a and total[b] - total[a] >= need:
                    best = i
        return best

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        tokens, elements = parsed(page)
        out = _left_out(tokens, elements)
        region = elements[self.region(tokens, elements, out)]
        kept = "".join(raw for kind, raw, at in tokens[region.first : region.last] if not out[at] or kind not in ("w", "wa"))
        return " ".join(html.unescape(kept).split())


def labelled_pages(n: int = PAGES, seed: int = 4) -> Iterator[tuple[str, str]]:
    """Made-up pages, and the name of the element that holds their main text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "ti", "on", "re", "sa", "lo", "mi")) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{some(1, 2)}</a></li>' for _ in range(k))
    for _ in range(n):
        content = r.choice(("article", "main", "div"))
        body = f"<h1>{some(3, 9)}</h1>" + "".join(r.choice((f"<p>{some(5, 90)}.</p>", f"<p>{some(5, 60)}", f"<p><b>{some(3, 20)}</b> {some(5, 40)}<br>{some(4, 30)}</p>", f"<ul><li>{some(3, 12)}</li><li>{some(3, 12)}</li></ul>", f"<p>{some(4, 30)} <a href='x'>{some(1, 3)}</a> {some(4, 20)}</p>")) for _ in range(r.randint(3, 20)))
        around = [f"<nav><ul>{links(r.randint(4, 12))}</ul></nav>", f"<header><a href='/'>{word()}</a></header>", f'<div class="ad">{some(3, 12)}</div>', f"<form><label>{word()}</label><input><button>{word()}</button></form>", f"<aside><h3>{word()}</h3><ul>{links(5)}</ul></aside>"]
        r.shuffle(around)
        after = [f'<div class="comments"><div class="comment"><p>{some(5, 20)}</p></div></div>', f"<footer>&copy; {some(3, 9)}</footer>", f"<ul>{links(6)}</ul>"]
        yield f"<html><head><title>{some(3, 6)}</title></head><body>{''.join(around[: r.randint(1, 5)])}<{content}>{body}</{content}>{''.join(after[r.randint(0, 1) :])}</body></html>", content


_EXTRACTOR: list[Extractor] = []


def extractor() -> Extractor:
    """The learned extractor, made once in a process: the same in all of them."""
    if not _EXTRACTOR:
        _EXTRACTOR.append(Extractor())
    return _EXTRACTOR[0]


def extract_main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with columns text and n_chars (code points) for every row, and without the html column.

    Null or empty html gives an empty text, as does a page without text. Rows are taken one by one: repeated rows stay.
    Columns of pages named text or n_chars are replaced.
    """
    spark = pages.sparkSession
    small_batches(spark)
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    source = pages.select(*kept, F.col(page).alias(page))
    shared = spark.sparkContext.broadcast(extractor())  # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for b in batches:
            texts = [e.text(x) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}text string, n_chars bigint")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
