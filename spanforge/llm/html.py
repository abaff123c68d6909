"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of text runs and tags.  Words score positive and tags negative, and words
inside boilerplate (navigation, adverts, forms, comments, ...) negative too; all weights are log
odds counted on a small table of labelled pages.  One linear scan finds the best contiguous run;
the text of that run outside boilerplate is returned.  Pages are handled one by one: no shuffle.

What an element is follows from its own tag and names: a name (class, id, role) with a part that
the labelled pages have in boilerplate makes it boilerplate, unless another of its names is one of
content, or the name only states a feature ("has-sidebar", "share-enabled").  ``article`` and
``main`` are content again inside boilerplate that is no comment, so a page whose frame has such a
name is not lost.  Each token takes constant time on average, however deep elements are nested.

Defined results: null or empty html, or a page whose best run scores nothing, gives an empty text;
an unfinished tag at the end of a page is dropped; a ``<`` that opens no tag is text; rows are
treated one by one, and a column of ``pages`` with the name of the output column is replaced by it.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)|</?\Z|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements whose content is never text; it runs to the matching end tag.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object"))
#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may be left open; they do not carry context.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option html body colgroup optgroup rt rp".split())


#: What an element is to the words in it; ASIDE is boilerplate of any kind inside content.
PLAIN, BAD, COMMENT, GOOD, ASIDE = 0, 1, 2, 3, 4
#: Elements that are boilerplate, and content, whatever their names.
SECTIONS = frozenset("nav header footer aside form head button menu dialog".split())
BODIES = frozenset(("article", "main"))
#: Parts of names that state a feature of an element, not what it is.
STATE_FIRST = frozenset("has is no not with without show hide can".split())
STATE_LAST = frozenset("open opened closed enabled disabled active inactive visible hidden on off allowed supported".split())
COMMENTS = frozenset("comment comments reply replies respond discussion disqus".split())


def kind_of(tag: str, names: list[str], bad: frozenset[str], good: frozenset[str]) -> int:
    """PLAIN, BAD, COMMENT or GOOD by an element's tag and names, given the parts of names of boilerplate and of content."""
    if tag in SECTIONS:
        return BAD
    worst, best = PLAIN, PLAIN
    for name in names:
        parts = _PART.findall(name.lower())
        if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
            continue
        if any(p in COMMENTS for p in parts):
            worst = COMMENT
        elif any(p in bad for p in parts):
            worst = max(worst, BAD)
        elif any(p in good for p in parts):
            best = GOOD
    if best == GOOD or worst == PLAIN and tag in BODIES:
        return GOOD
    return worst


def tokens(page: str, bad: frozenset[str] = frozenset(), good: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, int, bool]]:
    """(kind, value, what it lies in, breaks a block); kind is ``text`` or ``tag``."""
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    inside = PLAIN
    at, n, lowered = 0, len(page), None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if m[0] != "<" or at < n:
                    yield "text", m[0], inside, False
            continue
        name = name.lower()
        if m[1]:
            was = inside
            if open_[name]:
                while True:
                    top, before = stack.pop()
                    open_[top] -= 1
                    inside = before
                    if top == name:
                        break
            yield "tag", name, was, name not in INLINE
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find("</" + name, at) if len(lowered) == n else page.find("</" + name, at)
            stop = page.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else n
            yield "tag", name, inside, True
            continue
        names = " ".join("".join(g) for g in _NAMES.findall(m[3])).split() if m[3] and "=" in m[3] else []
        if name not in VOID and name not in LOOSE and not m[3].rstrip().endswith("/") and (name not in INLINE or names):
            stack.append((name, inside))
            open_[name] += 1
            kind = kind_of(name, names, bad, good)
            if kind in (BAD, COMMENT):
                inside = ASIDE if inside in (GOOD, ASIDE) else max(inside, kind)
            elif kind == GOOD and (inside == PLAIN or inside == BAD and name in BODIES):
                inside = GOOD
        yield "tag", name, inside, name not in INLINE


def labelled_pages(n: int = 60, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """A small table of labelled pages: each is a list of (html fragment, is main text)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda: "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(rng.randint(3, 9)))
    out = []
    for _ in range(n):
        page = [(f"<html><head><meta charset=utf-8><title>{some(3, 9)}</title><style>p{{}}</style><script>a()</script></head><body>", False)]
        noise = [
            lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f'<div class="menu navbar breadcrumb"><ul>{links()}</ul></div>',
            lambda: f"<header><div>{some(2, 6)}</div><ul>{links()}</ul></header>", lambda: f'<div class="{rng.choice(("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor"))}">{some(5, 14)}</div>',
            lambda: f'<aside class="{rng.choice(("sidebar", "related", "widget"))}"><h3>{some(1, 3)}</h3><ul>{links()}</ul></aside>', lambda: f'<div class="sidebar">{some(8, 20)}</div>',
            lambda: f'<div class="{rng.choice(("cookie", "notice", "alert", "popup", "modal", "consent", "gdpr", "subscribe", "newsletter", "share", "social", "disclaimer"))}"><p>{some(5, 15)}</p></div>',
            lambda: f"<form><label>{some(1, 3)}</label><input><button>{some(1, 2)}</button></form>",
        ]
        for make in rng.sample(noise, rng.randint(2, 5)):
            page.append((make(), False))
        opening = rng.choice(("<article>", "<main>", '<div class="content">', '<div id="post">', '<section class="entry">'))
        page.append((f"{opening}<h1>{some(4, 10)}</h1>", True))
        for _ in range(rng.randint(2, 12)):
            page.append((rng.choice((f"<p>{some(20, 90)}</p>", f"<p><b>{some(15, 60)}<br>", f"<p>{some(10, 40)} <a href=x>{some(1, 3)}</a> {some(5, 40)}</p>", f"<{(h := rng.choice(('h2', 'h3', 'h4')))}>{some(2, 6)}</{h}>", f"<ul><li>{some(5, 20)}</li><li>{some(5, 20)}</li></ul>", f"<blockquote>{some(8, 40)}</blockquote>")), True))
            if rng.random() < 0.15:
                page.append((noise[3](), False))
        page.append((f"</{opening[1:].split()[0].rstrip('>')}>", True))
        if rng.random() < 0.6:
            page.append((f'<section class="comments" id="comments"><h3>{some(1, 2)}</h3>' + "".join(f'<div class="{rng.choice(("comment", "reply"))}"><p>{some(8, 40)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>", False))
        if rng.random() < 0.5:
            page.append((noise[4](), False))
        page.append((f"<footer>&copy; {some(3, 12)}</footer></body></html>", False))
        out.append(page)
    return out


#: Log odds from which a part of a name speaks against, or for, being main text.
CLEAR = 1.5


@cache
def weights() -> tuple[frozenset[str], frozenset[str], dict[str, float], float, float]:
    """(parts of names of boilerplate, of content, weight by tag, of a plain word, of a boilerplate word), log odds on ``labelled_pages``."""
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    plain = [0, 0]
    for page in labelled_pages():
        for fragment, main in page:
            words = len(re.sub(r"<[^>]*>", " ", fragment).split())
            for names in _NAMES.findall(fragment):
                (inside if main else outside).update(dict.fromkeys(_PART.findall("".join(names).lower()), words))
            for kind, value, _, _ in tokens(fragment):
                if kind == "tag":
                    (tags_in if main else tags_out)[value] += 1
                else:
                    plain[not main] += len(value.split())
    odds = lambda a, b: math.log((a + 1) / (b + 1))
    score = {p: odds(inside[p], outside[p]) for p in {*inside, *outside}}
    tags = {t: min(-0.2, max(-2.0, odds(tags_in[t], tags_out[t]))) for t in {*tags_in, *tags_out}}
    bad = frozenset(p for p, x in score.items() if x < -CLEAR)
    good = frozenset(p for p, x in score.items() if x > CLEAR)
    return bad, good, tags, min(1.0, max(0.3, odds(*plain))), min(score.values())


#: Least score of one run of boilerplate text.
RUN_COST = -20.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous run with the highest positive sum, the first of equal ones; (0, 0) if there is none."""
    total, best, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, span = total, (begin, i + 1)
    return span


def main_text(page: str | None) -> str:
    """Text of the best contiguous run of tokens, outside boilerplate, white space collapsed."""
    if not page:
        return ""
    bad, good, tag_w, plain, boiler = weights()
    parts: list[str | None] = []  # text, or a space for a break, or None for what is left out
    scores: list[float] = []
    for kind, value, inside, breaks in tokens(page, bad, good):
        marked = inside in (GOOD, ASIDE)  # inside marked content, tags and boilerplate do not tell where content ends
        if kind == "tag":
            scores.append(0.0 if marked else -0.2 if inside in (BAD, COMMENT) else tag_w.get(value, -0.2))
            parts.append(" " if breaks or value == "br" else None)
        elif inside in (BAD, COMMENT, ASIDE):
            scores.append(0.0 if marked else max(RUN_COST, len(value.split()) * boiler))
            parts.append(None)
        else:
            scores.append(len(value.split()) * plain)
            parts.append(value)
    a, b = best_run(scores)
    return " ".join(_html.unescape("".join(x for x in parts[a:b] if x is not None)).split())


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns of ``pages`` and ``out_col``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != out_col) + f", `{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textnp import column, slices

        for batch in slices(batches, html_col):
            text = pa.array([main_text(p) for p in column(batch, html_col).to_pylist()], pa.string())
            keep = [i for i, name in enumerate(batch.schema.names) if name != out_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), text], [*(batch.schema.names[i] for i in keep), out_col])

    return pages.mapInArrow(run, schema)
