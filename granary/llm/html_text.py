"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page becomes a sequence of words and tags. A tag costs a weight of its own, a word earns the weight of the element
that it stands in; both are log-odds learned from labelled pages: pages that mark their main text with <article> or
<main>, a bounded sample of them. One linear scan (Kadane) finds the contiguous region with the greatest sum, and the
region's text is read out block by block. Inside the region, elements that are never main text (scripts, styles,
forms, menus, asides, adverts, comment sections and the like, by name or by a word of their class, id or role) are
skipped, and cost nothing where they stand in an <article> or <main>. Such a word tells nothing where the element holds
the main element or most of the page's words: a text may be about a notice, or shared.

Cases: null html gives the empty text; so does a page without words outside such elements. Repeated rows are treated
alike. Unclosed elements end where an enclosing one ends; a tag cut off by the end of the page is dropped. Very long
pages take time and memory in proportion. Without labelled pages the prior weights hold. Extra columns are carried
along by extract(); columns with its output's names, in any letter case, are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, bounded_sample, by_chars

#: Labelled pages to learn from at most: those with the smallest hash.
MAX_LABELLED = 2_000
#: HTML's elements by role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NEVER = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "embed", "head", "title", "nav", "aside", "footer", "form", "button", "select", "textarea", "input", "menu", "dialog", "noembed", "noframes", "xmp"}
NEVER_WORDS = {"ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
MAIN = {"article", "main"}
SKIP = "skip"
#: The share of a page's words that makes an element's class say nothing.
MOST = 0.8
LANDMARK = {"html", "head", "body", "header", "section"} | NEVER | MAIN

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)(>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def parse(page: str, trusted: frozenset | None = None):
    """(kind, name, value, context): kind is 'open', 'close' or 'text'; context is the landmark a token stands in.

    A text's value is its decoded characters and whether they may be main text at all. trusted: numbers of the marked
    elements whose marks say nothing; by default those with a main element or most of the words, found by a first pass.
    """
    out, pos = [], 0
    stack: list[tuple] = []  # name, context, never, whether by a name, number of the mark
    at: dict[str, list[int]] = {}  # where the open elements of a name stand on the stack
    words = mains = n_marked = 0
    opened: dict[int, list] = {}  # of marked elements: words and main elements before, whether in a main one, both after

    def closed(entry: tuple) -> None:
        at[entry[0]].pop()
        if entry[4] is not None:
            opened[entry[4]] += [words, mains]

    while pos < len(page):
        m = TOKEN.match(page, pos)
        pos = m.end()
        name = m[2]
        top = stack[-1] if stack else ("", "", False, False, None)
        if name is None:
            t = m[0]
            if t.startswith("<!") or t.startswith("<?"):
                continue
            value = html.unescape(t)
            words += 0 if top[3] else len(value.split())
            out.append(("text", "", value, top[1], top[2]))
            continue
        name = name.lower()
        if m[4] != ">" and pos >= len(page):
            break  # cut off in the middle of a tag
        if m[1]:
            was = ("", "", False)
            if at.get(name):
                to = at[name][-1]
                was = stack[to]
                while len(stack) > to:
                    closed(stack.pop())
            top = stack[-1] if stack else ("", "", False)
            out.append(("close", name, name, SKIP if was[1] == SKIP else top[1], top[2]))
            continue
        marked, number = "", None
        if m[3]:
            found = set(WORD.findall(" ".join(a or b or c for a, b, c in MARKS.findall(m[3])).lower())) & NEVER_WORDS
            if found:
                number, n_marked = n_marked, n_marked + 1
                marked = min(found) if number not in (trusted or ()) else ""
        by_name = top[3] or name in NEVER or (name == "header" and top[1] not in MAIN)
        never = top[2] or by_name or bool(marked)
        context = marked or (name if name in LANDMARK else top[1])
        if never and (top[1] in MAIN or top[1] == SKIP):
            context = SKIP  # left out of a main text, but no reason to end it
        out.append(("open", name, f"{name}.{marked}" if marked else name, context, never))
        if number is not None:
            opened[number] = [words, mains, top[1] in MAIN]
        mains += name in MAIN
        if name in VOID or m[3].rstrip().endswith("/"):
            if number is not None:
                opened[number] += [words, mains]
            continue
        at.setdefault(name, []).append(len(stack))
        stack.append((name, context, never, by_name, number))
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, pos)
            stop = end.start() if end else len(page)
            if stop > pos:
                out.append(("text", "", page[pos:stop], context, True))
            pos = stop
    if trusted is None and opened:
        while stack:
            closed(stack.pop())
        most = frozenset(i for i, (w0, m0, within, w1, m1) in opened.items() if m1 > m0 or (w1 - w0 > MOST * words and (within or not mains)))
        if most:
            return parse(page, most)
    return out


def tag_key(kind: str, value: str, context: str) -> str:
    """A tag in a marked main text is another than that tag elsewhere: lists are not menus there."""
    return ("/" if kind == "close" else "") + value + (f"@{context}" if context in MAIN else "")


def label(page: str):
    """Counts of words by context and of tags, in and out of a page's marked main text; None if none is marked."""
    tokens = parse(page)
    if not any(k == "open" and n in MAIN for k, n, *_ in tokens):
        return None
    counts, depth = Counter(), 0
    for kind, name, value, context, never in tokens:
        if context == SKIP:
            continue
        if kind == "text":
            n = len(value.split())
            if n:
                counts["word", context, depth > 0 and not never] += n
        else:
            if kind == "close" and name in MAIN and depth:
                depth -= 1
                counts["tag", tag_key(kind, value, context), False] += 1
            else:
                inside = depth > 0 and not never
                counts["tag", tag_key(kind, value, context), inside] += 1
                depth += kind == "open" and name in MAIN
    return counts


class PageModel:
    """Weights: words by context, tags by name; unknown contexts and tags have the priors' weights."""

    def __init__(self, counts: Counter | None = None):
        counts = counts or Counter()
        self.word: dict[str, float] = {}
        self.tag: dict[str, float] = {}
        for kind, name in {(k, n) for k, n, _ in counts}:
            inside, outside = counts[kind, name, True], counts[kind, name, False]
            odds = math.log((inside + 0.5) / (outside + 0.5))
            if kind == "word":
                self.word[name] = max(-3.0, min(1.0, odds))
            else:
                self.tag[name] = max(-3.0, min(-0.05, odds if "@" in name else (odds - 3.0) / 2))

    def of_word(self, context: str, never: bool) -> float:
        return self.word.get(context, -1.0 if never else 1.0) if not never else min(self.word.get(context, -1.0), -0.25)

    def of_tag(self, name: str) -> float:
        w = self.tag.get(name)
        if w is None:
            name, _, within = name.partition("@")
            base = name.lstrip("/").split(".")[0]
            w = -0.1 if within else -2.0 if "." in name or base in NEVER else -0.1 if base in INLINE or base in ("p", "div", "h1", "h2", "h3", "h4", "li", "blockquote", "pre") else -0.5
        return w


def best_region(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous region with the greatest sum begins and ends: the first such, and the shortest, as none of
    its beginnings has a sum of 0 or less. (0, 0) if no sum is above 0."""
    best = total = 0.0
    first = start = end = 0
    for i, x in enumerate(scores):
        total += x
        if total > best:
            best, first, end = total, start, i + 1
        if total <= 0:
            total, start = 0.0, i + 1
    return first, end


def token_scores(tokens: list, model: PageModel) -> list[float]:
    out = []
    for kind, _name, value, context, never in tokens:
        if context == SKIP:
            out.append(0.0)
        elif kind == "text":
            n = len(value.split())
            out.append(n * model.of_word(context, never) if n else 0.0)
        else:
            out.append(model.of_tag(tag_key(kind, value, context)))
    return out


def main_text(page: str | None, model: PageModel) -> str:
    tokens = parse(page or "")
    first, end = best_region(token_scores(tokens, model))
    blocks, block = [], []
    for kind, name, value, _context, never in tokens[first:end]:
        if kind == "text":
            if not never:
                block.append(value)
        elif name not in INLINE:
            blocks.append(block)
            block = []
        elif name == "br":
            block.append(" ")
    blocks.append(block)
    texts = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def fit(pages: DataFrame, column: str = "html", max_labelled: int = MAX_LABELLED) -> PageModel:
    """From at most max_labelled pages that mark their main text; the counts have a row for each tag and context."""
    c = Carried(pages)
    marked = c.df.select(F.col(c.at(column)).cast("string").alias("h")).where(F.lower("h").contains("<article") | F.lower("h").contains("<main"))
    hashes = marked.select(F.xxhash64("h").alias("k")).distinct()
    chosen = bounded_sample(hashes, F.col("k"), max_labelled)  # so few hashes that they may be broadcast
    sample = marked.withColumn("k", F.xxhash64("h")).join(F.broadcast(chosen), "k", "left_semi").select("h")

    def count(batches):
        total = Counter()
        for b in batches:
            for h in b.column("h").to_pylist():
                total.update(label(h) or {})
        if total:
            kind, name, inside = (list(x) for x in zip(*total))
            yield pa.RecordBatch.from_pydict({"kind": kind, "name": name, "inside": inside, "n": list(total.values())})

    got = sample.mapInArrow(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return PageModel(Counter({(r.kind, r.name, r.inside): r.n for r in got.collect()}))  # names in a bounded sample


def extract(pages: DataFrame, model: PageModel, column: str = "html") -> DataFrame:
    """pages, without the html, with text and n_chars (its code points)."""
    c = Carried(pages, "text", "n_chars", column)
    rows, at = c.with_text(column)
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def apply(batches):
        for b in by_chars(batches, at):
            texts = [main_text(h, model) for h in b.column(at).cast(pa.string()).to_pylist()]
            cols = [c for c, n in zip(b.columns, b.schema.names) if n != at]
            names = [n for n in b.schema.names if n != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return c.back(rows.mapInArrow(apply, T.StructType([*[f for f in rows.schema.fields if f.name != at], *new])), "text", "n_chars")
