"""Main text of web pages: a classifier's costs and smoothness between neighbours, parted by a minimum cut."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ._store import small_batches, trimmed

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>|<[!?][^>]*+>", re.S)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden[\s=>/]|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without an end, elements whose text is not shown, and elements that end a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
UNSEEN = set("head noscript template svg math iframe object audio video canvas select option button datalist".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table article section div body main aside nav footer header form".split())

#: Elements and words of class, id or role that speak against or for main text.
AGAINST_TAGS = set("nav aside footer form menu dialog fieldset".split())
AGAINST = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner popup modal overlay cookie cookies consent gdpr notice "
    "alert sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer foot header masthead topbar comment "
    "comments reply replies respond disqus discussion share sharing social related recommended recommendation more newsletter subscribe subscription signup login "
    "search tags meta byline copyright disclaimer".split()
)
FOR_TAGS = {"article", "main"}
FOR = set("article post entry content story body text main hentry".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Block:
    """A line of text with what is around it: the nearest block element, whether any element speaks against or for main text, and the number of the innermost element's parent.

    ``depth`` is how many elements are open, ``shared`` how many of them were already open for the line before.
    """

    text: str
    tag: str
    link_chars: int
    against: bool
    good: bool
    hidden: bool
    parent: int
    depth: int
    shared: int


@dataclass
class _Open:
    """An open element; all but its number and tag hold for the elements around it too."""

    number: int
    tag: str
    block: str
    against: bool
    good: bool
    hidden: bool
    article: bool


def blocks(html: str) -> list[Block]:
    """The lines of text of a page in order, character references decoded, white space runs as one space; empty lines left out."""
    out: list[Block] = []
    top = _Open(0, "", "body", False, False, False, False)
    stack: list[_Open] = []
    opened: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    count, links, unseen, shared = 0, 0, 0, 0

    def end() -> None:
        nonlocal shared
        text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
        if text:
            linked = sum(len(p) for p, in_link in parts if in_link)
            o = stack[-1] if stack else top
            out.append(Block(text, o.block, linked, o.against, o.good, o.hidden, stack[-2].number if len(stack) > 1 else 0, len(stack), shared))
            shared = len(stack)
        parts.clear()

    def close(k: int) -> None:
        nonlocal links, unseen, shared
        for o in stack[k:]:
            links -= o.tag == "a"
            unseen -= o.tag in UNSEEN
            opened[o.tag] -= 1
        del stack[k:]
        shared = min(shared, k)

    def close_last(tags: set[str], stop: set[str]) -> None:
        """Close the innermost element of these tags, unless one of ``stop`` is in between."""
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in stop:
                return

    def put(text: str) -> None:
        if text and not unseen:
            parts.append((unescape(text), links > 0))

    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        if m is None:
            put(html[pos:])
            break
        put(html[pos : m.start()])
        pos, token = m.end(), m.group()
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        tag = NAME.match(token, 1 + closing).group().lower()
        if closing:
            if tag in BLOCK:
                end()
            if tag in UNSEEN or tag in BLOCK or tag not in VOID:
                close_last({tag}, set() if tag in BLOCK else BLOCK)  # an inline end tag reaches no further than its line
            continue
        if tag in RAW:
            m = re.compile(f"</{tag}", re.I).search(html, pos)
            if m is None:
                break
            pos = html.find(">", m.end())
            pos = n if pos < 0 else pos + 1
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK:
            end()
            if tag in CLOSES_P:
                close_last({"p"}, SCOPE)
            if tag in SIBLING:
                close_last(SIBLING[tag], SCOPE)
        elif tag == "a":
            close_last({"a"}, BLOCK)
        if tag == "body" and opened["head"]:
            close(next(k for k, o in enumerate(stack) if o.tag == "head"))
        if tag in VOID or token.endswith("/>"):
            continue
        words = {w for g in HINT.findall(token) for w in re.split(r"[^a-z]+", "".join(g).lower())} if "=" in token else set()
        count += 1
        o = stack[-1] if stack else top
        article = o.article or tag in FOR_TAGS
        # A header inside an article is the article's.
        against = bool(words & AGAINST) or tag in AGAINST_TAGS or (tag == "header" and not article)
        good = tag in FOR_TAGS or (bool(words & FOR) and not words & AGAINST)
        stack.append(_Open(count, tag, tag if tag in BLOCK else o.block, o.against or against, o.good or good, o.hidden or (" " in token and bool(HIDDEN.search(token))), article))
        opened[tag] += 1
        links += tag == "a"
        unseen += tag in UNSEEN
    end()
    return out


FEATURES = 11


def features(b: Block) -> list[float]:
    n, words = len(b.text), b.text.count(" ") + 1
    against, good = b.against or b.hidden, b.good
    return [
        1.0, against, good and not against, min(1.0, b.link_chars / n), min(np.log1p(words), 6.0) / 6, b.text[-1] in ".!?:;\"')…»”",
        b.tag in HEADINGS, b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "td", "th", "dt", "dd"), words < 4, against and good,
    ]


def _sample(rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A page by a random template with the truth of each line; \\x01 marks main text until it is parsed."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 10)))
    line = lambda lo, hi: " ".join(word() for _ in range(rng.integers(lo, hi))) + rng.choice([".", ".", "", "?"])
    true = lambda lo, hi: "\x01" + line(lo, hi)
    link = lambda: f'<a href="/x">{line(1, 4)}</a>'
    some = lambda f, lo, hi: "".join(f() for _ in range(rng.integers(lo, hi)))
    pick = lambda words: str(rng.choice(sorted(words)))
    body = f"<h1>{true(2, 9)}</h1>" + some(lambda: f"<p>{true(1, 80)}</p>" if rng.random() < 0.85 else f"<ul>{some(lambda: f'<li>{true(1, 20)}</li>', 1, 5)}</ul><h2>{true(1, 6)}</h2>", 2, 12)
    if rng.random() < 0.3:
        body += f'<div class="{pick(AGAINST)}">{some(lambda: f"<p>{line(2, 30)}</p>", 1, 4)}</div>'
    shell = rng.integers(4)
    body = [f"<article>{body}</article>", f"<main>{body}</main>", f'<div class="{pick(FOR)}">{body}</div>', f"<div>{body}</div>"][shell]
    bad = lambda: str(rng.choice([f"<nav><ul>{some(lambda: f'<li>{link()}</li>', 2, 8)}</ul></nav>", f"<aside><h3>{line(1, 4)}</h3><p>{line(2, 30)}</p></aside>", f'<div class="{pick(AGAINST)}">{line(2, 30)}</div>', f"<form><label>{line(1, 4)}</label></form>", f"<div>{some(lambda: link() + ' | ', 2, 6)}</div>"]))
    page = f"<body><header><a href='/'>{line(1, 3)}</a></header>{some(bad, 0, 4)}{body}{some(bad, 0, 3)}<footer>&copy; {line(1, 12)}</footer></body>"
    out = []
    for b in blocks(page):
        truth = "\x01" in b.text
        b.text = b.text.replace("\x01", "").strip() or "."
        out.append((b, truth))
    return out


def train(pages: int = 300, seed: int = 11) -> np.ndarray:
    """Weights of a logistic classifier of lines, from labelled pages that are generated by templates."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = [x for _ in range(pages) for x in _sample(rng)]
    x, y = np.array([features(b) for b, _ in rows], float), np.array([t for _, t in rows], float)
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(FEATURES)
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
    return w


#: Capacity between neighbours that share their parent; less for those whose common element is further up.
SMOOTH = 0.8


def edges(lines: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, weaker the more elements lie between them, and lines of one parent that others part."""
    out, last = [], {}
    for i, b in enumerate(lines):
        if i:
            out.append((i - 1, i, SMOOTH / (1 + max(0, lines[i - 1].depth + b.depth - 2 * b.shared - 2))))
        if b.parent in last and last[b.parent] < i - 1:
            out.append((last[b.parent], i, SMOOTH / 2))
        last[b.parent] = i
    return out


def cut(for_main: np.ndarray, for_other: np.ndarray, links: list[tuple[int, int, float]]) -> list[bool]:
    """The labels of least cost: for_main[i] is what label 'other' costs line i, for_other[i] what label 'main' costs.

    Maximum flow by blocking flows: a search from all lines that lean to main text gives levels, and walks along rising levels
    saturate all shortest paths before the next search. A line's two terminal capacities are cancelled against each other first,
    so paths run only between lines that lean to different labels. Of equal cuts the one with the fewest lines of main text results.
    """
    n = len(for_main)
    free = (for_main - for_other).tolist()
    joined: dict[tuple[int, int], float] = {}
    for a, b, c in links:
        key = (min(a, b), max(a, b))
        joined[key] = joined.get(key, 0.0) + c
    # Arc 2k runs one way along link k, arc 2k + 1 the other way.
    heads: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for (a, b), c in joined.items():
        arcs[a].append(len(heads))
        arcs[b].append(len(heads) + 1)
        heads += [b, a]
        room += [c, c]
    tiny = 1e-9
    while any(x < -tiny for x in free):
        level = [0 if x > tiny else -1 for x in free]
        queue, met = [i for i in range(n) if level[i] == 0], n + 1
        for v in queue:
            if level[v] >= met:
                break
            for e in arcs[v]:
                u = heads[e]
                if level[u] < 0 and room[e] > tiny:
                    level[u] = level[v] + 1
                    queue.append(u)
                    if free[u] < -tiny:
                        met = min(met, level[u])
        if met > n:
            break
        at = [0] * n
        for first in range(n):
            path: list[int] = []
            v = first if level[first] == 0 else -1
            while v >= 0 and free[first] > tiny:
                if free[v] < -tiny and path:
                    flow = min(free[first], -free[v], *(room[e] for e in path))
                    free[first] -= flow
                    free[v] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    # Go on from the first full arc's tail.
                    k = next((k for k, e in enumerate(path) if room[e] <= tiny), len(path) if free[v] < -tiny else len(path) - 1)
                    del path[k:]
                    v = heads[path[-1]] if path else first
                    continue
                while at[v] < len(arcs[v]):
                    e = arcs[v][at[v]]
                    if room[e] > tiny and level[heads[e]] == level[v] + 1 and level[heads[e]] <= met:
                        break
                    at[v] += 1
                if at[v] < len(arcs[v]):
                    path.append(arcs[v][at[v]])
                    v = heads[path[-1]]
                elif path:
                    level[v] = -2  # no way on from here in these levels
                    v = heads[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
    main = [x > tiny for x in free]
    queue = [i for i in range(n) if main[i]]
    for v in queue:
        for e in arcs[v]:
            u = heads[e]
            if room[e] > tiny and not main[u]:
                main[u] = True
                queue.append(u)
    return main


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The lines of main text, joined by line breaks; null and empty pages have none."""
    lines = blocks(html or "")
    if not lines:
        return ""
    logit = np.clip(np.array([features(b) for b in lines], float) @ weights, -8, 8)
    keep = cut(np.logaddexp(0, logit), np.logaddexp(0, -logit), edges(lines))
    return "\n".join(b.text for b, k in zip(lines, keep) if k)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text) for every row, each page by itself and whole; no shuffle.

    Broken markup never fails: what is no tag is text, elements without an end last to their parent's, a comment, script or
    style without an end lasts to the page's. Repeated rows are read one by one; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    small_batches(spark)
    w = train() if weights is None else weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                texts = [main_text(x.as_py(), w) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(lambda b: trimmed(each(b)), "page_id long, url string, text string")


def op7_html(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
