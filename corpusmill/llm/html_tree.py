"""HTML extraction by a tree-structured graphical model: parent-child potentials join DOM nodes, sum-product gives content marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.labelled_pages import PAGES
from corpusmill.llm.words import small_batches

_BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure "
    "figcaption header footer nav aside form fieldset address details summary hr center dialog search menu label button select option textarea".split())
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style noscript template svg math head title iframe object canvas select textarea button".split())
_ENDS_P = _BLOCKS - {"label", "button", "select", "option", "textarea"}
_SPACE = re.compile(r"\s+")
_ALIKE = ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"})


class Page(HTMLParser):
    """Block elements of a page as nodes in page order (parents first), and the text blocks under them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marks, self.labels = ["#root"], [-1], [()], [True]
        self.size, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.silent = self.links = 0
        self.held: list[str] = []
        self.feed(html)
        self.close()
        self.flush()
        for i in range(len(self.tags) - 1, 0, -1):
            self.size[self.parents[i]] += self.size[i]
            self.linked[self.parents[i]] += self.linked[i]

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.held)).strip()
        self.held = []
        if text:
            self.blocks.append((self.open[-1][1], text))

    def pop(self) -> None:
        tag, _ = self.open[-1]
        if tag in _BLOCKS:
            self.flush()
        self.silent -= tag in _SILENT
        self.links -= tag == "a"
        self.open.pop()

    def close_until(self, tags: frozenset | set, stops: frozenset | set) -> None:
        """Closes the nearest open element of ``tags``, unless one of ``stops`` lies nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _EMPTY:
            if tag in ("br", "hr", "wbr"):
                self.held.append(" " if tag != "wbr" else "")
            if tag == "hr":
                self.flush()
            return
        if tag in _ENDS_P:
            self.close_until({"p"}, _BLOCKS - {"p"})
        for alike in _ALIKE:
            if tag in alike:
                self.close_until(alike, {"ul", "ol", "dl", "table", "select"} | ({"tr"} if "td" in alike else set()))
        node = self.open[-1][1]
        if tag in _BLOCKS:
            self.flush()
            told = dict(attrs)
            words = " ".join(str(told.get(k) or "") for k in ("class", "id", "role")).lower()
            self.tags.append(tag)
            self.parents.append(node)
            self.marks.append(tuple(sorted(set(re.findall("[a-z]+", words)))))
            self.labels.append("data-main" in told)
            self.size.append(0)
            self.linked.append(0)
            node = len(self.tags) - 1
        self.silent += tag in _SILENT
        self.links += tag == "a"
        self.open.append((tag, node))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            self.close_until({tag}, frozenset() if tag in _BLOCKS else _BLOCKS)

    def handle_data(self, data):
        if self.silent == 0:
            self.held.append(data)
            count = len(data) - data.count(" ")
            node = self.open[-1][1]
            self.size[node] += count
            self.linked[node] += count if self.links > 0 else 0

    def features(self, node: int) -> list[str]:
        share = self.linked[node] / self.size[node] if self.size[node] else 0.0
        return [f"tag {self.tags[node]}", *[f"mark {m}" for m in self.marks[node]],
                f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}"]


def train(pages: Sequence[str] = PAGES) -> dict:
    """Potentials in logarithms from labelled pages, counts smoothed by one half: per feature and label, and per parent and child label."""
    seen = (Counter(), Counter())
    nodes, pairs = Counter(), Counter()
    for html in pages:
        page = Page(html)
        for i in range(1, len(page.tags)):
            label = int(page.labels[i])
            nodes[label] += 1
            seen[label].update(page.features(i))
            pairs[int(page.labels[page.parents[i]]), label] += 1
    names = set(seen[0]) | set(seen[1])
    own = {n: tuple(math.log((seen[y][n] + 0.5) / (nodes[y] + 1)) for y in (0, 1)) for n in names}
    step = tuple(tuple(math.log((pairs[x, y] + 0.5) / (pairs[x, 0] + pairs[x, 1] + 1)) for y in (0, 1)) for x in (0, 1))
    return {"own": own, "step": step}


def _sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def marginals(page: Page, model: dict) -> list[float]:
    """The probability of content at each node: messages go up to the root, then down; exact on a tree."""
    own, step, n = model["own"], model["step"], len(page.tags)
    local = [[0.0, 0.0] for _ in range(n)]
    for i in range(1, n):
        for name in page.features(i):
            if name in own:
                local[i][0] += own[name][0]
                local[i][1] += own[name][1]
    below = [list(x) for x in local]
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        up[i] = tuple(_sum(step[x][0] + below[i][0], step[x][1] + below[i][1]) for x in (0, 1))
        p = page.parents[i]
        below[p][0] += up[i][0]
        below[p][1] += up[i][1]
    down = [[-20.0, 0.0] for _ in range(n)]  # a page as a whole holds content
    for i in range(1, n):
        p = page.parents[i]
        rest = [down[p][x] + below[p][x] - up[i][x] for x in (0, 1)]
        down[i] = [_sum(rest[0] + step[0][y], rest[1] + step[1][y]) for y in (0, 1)]
    out = []
    for i in range(n):
        gap = max(-700.0, min(700.0, down[i][0] + below[i][0] - down[i][1] - below[i][1]))
        out.append(1 / (1 + math.exp(gap)))
    return out


def main_text(html: str | None, model: dict) -> str:
    """The blocks whose node is content with a probability of at least one half, joined by a line end; empty if none."""
    if not html:
        return ""
    page = Page(html)
    likely = marginals(page, model)
    return "\n".join(text for node, text in page.blocks if likely[node] >= 0.5)


def _extract(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column("__html").to_pylist()]
            names = [n for n in batch.schema.names if n != "__html"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.string())], [*names, "text"])
    return run


def extract(pages: DataFrame, html: str = "html", model: dict | None = None) -> DataFrame:
    """``pages`` without ``html``, plus ``text`` (the article) and ``n_chars`` (its code points).

    A null or empty page, and one without content, has an empty text. Broken markup is read as browsers do as far as paragraphs,
    list items and cells go. White space inside a block becomes one space; blocks are joined by a line end; nothing is cut. Rows are never
    dropped; columns named text or n_chars are replaced. A projection without shuffle; the model is a few hundred numbers.
    """
    small_batches(pages.sparkSession)
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*keep, F.col(f"`{html}`").alias("__html"))
    out = rows.drop("__html").schema.add("text", "string")
    return rows.mapInArrow(_extract(model or train()), out).withColumn("n_chars", F.length("text").cast("long"))
