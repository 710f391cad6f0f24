"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags. A linear classifier
scores each block from its enclosing elements, their class and id words, its length,
punctuation and share of link text. Its weights are fitted by logistic regression to the
blocks of at most FIT_PAGES pages, those of least hash of their id among pages that mark
their main text with an `article` or `main` element: blocks in it are content but for those
in navigation, asides, forms and the like, all others are boilerplate. Whether a block lies
in such an element is no feature of the fit, so pages without one are read alike; it adds a
small fixed score. The listed weights are the mean of the fit's normal prior, and are used
as they are where no page marks its text.

Scores are held within MOST_SCORE and become terminal capacities of a graph: what it costs
to call the block boilerplate, and content. Blocks that follow each other, and those with
the same parent element, are joined by smoothness edges that grow weaker with their distance
in the document tree. The minimum cut, found by maximum flow, is the labelling of least
total cost. Blocks whose own cost outweighs all their edges are labelled at once, which
leaves the cut as it is and the graph small.

Character references are decoded, white space inside a block becomes one space, and the
content blocks are joined by an empty line in page order.

Defined cases: null or empty html gives the empty text; a page without any content
block as well; malformed markup is read leniently, in time that grows with its length, and
never raises: markup that does not end is text; repeated rows are
extracted each on its own; nothing is cut at any length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# HTML's element names by their part in a page's layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math canvas audio video head title".split())
#: What may stand in a head; the start of another element ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option optgroup p pre section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html head option optgroup label button".split())
#: What the start of an element ends, unless a list or table lies between.
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table select article section div body nav aside footer header main".split())

# The classifier's prior weights: of enclosing elements, of words of their class, id and role, of a block's own element.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus "
    "cookie cookies consent gdpr notice alert popup modal overlay toast copyright disclaimer legal footer foot header masthead topbar navbar nav "
    "navigation menu sidebar side rail widget related recommended promo promotion sponsor sponsored share sharing social subscribe subscription "
    "newsletter signup login register search pagination pager toolbar tags outbrain taboola complementary contentinfo dialog".split()
)
CONTENT_WORDS = frozenset("article articlebody content post entry story main text body".split())
ASIDE = frozenset("nav aside form menu dialog select button textarea label legend fieldset footer".split())
#: Elements that mark the main text, and what lying in one adds; not fitted.
MARKS = {"article": 2.0, "main": 1.2}
MOST_BIN = 11
PRIOR = (
    {f"in:{t}": -4.0 for t in [*ASIDE, "header"]}
    | {f"word:{w}": -4.0 for w in BOILERPLATE_WORDS}
    | {f"word:{w}": 0.5 for w in CONTENT_WORDS}
    | {f"own:{t}": x for t, x in {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5, "li": -0.3, "td": -0.3, "th": -0.3, "figcaption": 0.2}.items()}
    | {f"long:{k}": min(0.018 * 2**k, 2.4) for k in range(MOST_BIN + 1)}
    | {f"links:{k}": -float(k) for k in range(5)}
    | {"bias": -1.2, "sentence": 0.6, "hidden": -6.0}
)
#: Pages of the fit at most, the prior's precision, and the bound of a block's score.
FIT_PAGES, PRECISION, MOST_SCORE = 300, 4.0, 5.0
#: Smoothness: of blocks in page order, and of blocks with the same parent.
NEXT_EDGE, SIBLING_EDGE = 1.5, 0.75
#: Inline elements that take less from the score are not told apart from the text around.
LEAST_SAY = -3.0

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|\b(hidden)\b""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def own_features(tag: str, attributes: str, in_article: bool) -> list[str]:
    """What an element says of the blocks in it."""
    found = []
    if tag in ASIDE or (tag == "header" and not in_article):
        found.append(f"in:{tag}")
    if attributes:
        for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
                found.append("hidden")
            elif name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
                found += {f"word:{w.lower()}" for w in WORD.findall(value)}
    return found


class Element:
    __slots__ = ("tag", "parent", "depth", "score", "own", "unseen", "in_article", "aside")

    def __init__(self, tag: str, attributes: str, parent: Element | None, weights: dict[str, float]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.unseen = tag in UNSEEN or (parent is not None and parent.unseen)
        above = parent is not None and parent.in_article
        self.in_article = tag in MARKS or above
        self.aside = tag in ASIDE or (parent is not None and parent.aside)
        self.own = own_features(tag, attributes, above)
        self.score = sum(weights.get(f, 0.0) for f in self.own) + (0.0 if above else MARKS.get(tag, 0.0)) + (parent.score if parent else 0.0)


class Markup:
    """Finds the markup of a page one after the other, each character being looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.gone = {"'": len(page), '"': len(page)}  # from where on a quote does not occur

    def after(self, at: int):
        """(start, end, is an end tag, name, attributes) of the first markup from `at` on, or None."""
        page = self.page
        while 0 <= (at := page.find("<", at)) < self.last:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            closing = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + closing)
            if name:
                end = self._end(name.end())
                return at, end, closing, name[0].lower(), page[name.end() : end - 1]
            if page[at + 1] in "!?/":
                return at, page.find(">", at) + 1, False, "", ""
            at += 1
        if page.startswith("<!--", at) if at >= 0 else False:
            return at, len(page), False, "", ""
        return None

    def _end(self, at: int) -> int:
        """Past the first > that is not quoted; past the first of all where quotes don't end."""
        page, i = self.page, at
        while m := STOP.search(page, i):
            c, i = m[0], m.end()
            if c == ">":
                return i
            close = page.find(c, i) if i < self.gone[c] else -1
            if close < 0:
                self.gone[c] = min(self.gone[c], i)
                break
            i = close + 1
        return page.find(">", at) + 1


def blocks(page: str, weights: dict[str, float] = PRIOR) -> list[tuple[str, int, Element]]:
    """The blocks of a page: text, characters of it in links, and the element that holds it."""
    found, top, parts, linked, in_link, at = [], Element("", "", None, weights), [], 0, False, 0
    open_, markup = Counter(), Markup(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not top.unseen:
                found.append((text, min(linked, len(text)), top))
            parts, linked = [], 0

    def say(raw):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(tags, barrier=frozenset()):
        """Ends the innermost open element of `tags`, and all in it."""
        nonlocal top
        if not any(open_[t] for t in tags):
            return False
        x = top
        while x.parent is not None and x.tag not in tags and x.tag not in barrier:
            x = x.parent
        if x.parent is None or x.tag not in tags:
            return False
        while top is not x.parent:
            open_[top.tag] -= 1
            top = top.parent
        return True

    size = len(page)
    while at < size:
        m = markup.after(at)
        if m is None:
            say(page[at:])
            break
        start, end, closing, tag, attributes = m
        say(page[at:start])
        at = end
        if not tag:
            continue
        block = tag in BLOCK
        if closing:
            if tag == "a":
                in_link = False
            if block or tag in UNSEEN:
                flush()
                if block:
                    in_link = False
                close((tag,), frozenset(("table",)) if tag in ("li", "p") else frozenset())
            elif tag not in VOID:
                close((tag,), BLOCK)
            continue
        if top.tag == "head" and tag not in IN_HEAD:
            flush()
            close(("head",))
        if block or tag in UNSEEN:
            flush()
            in_link = False
            if tag in ENDS_P:
                close(("p",), HOLDS | {"td", "th", "button"})
            if tag in ENDS_OWN:
                while close(ENDS_OWN[tag], HOLDS - {"section", "div"}):
                    pass
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = True
        if tag in VOID:
            continue
        if block or tag in UNSEEN or "class" in attributes or "id=" in attributes or "hidden" in attributes or "style" in attributes:
            inner = Element(tag, attributes, top, weights)
            if not (block or tag in UNSEEN) and inner.score - top.score > LEAST_SAY:
                continue  # inline markup without a say
            if not block:
                flush()
            top = inner
            open_[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            body = page[at : end.start() if end else size]
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or size
            if tag == "textarea":
                say(body)
            flush()
            close((tag,))
    flush()
    return found


def text_features(text: str, linked: int, holder: Element) -> list[str]:
    """What a block's own text and element say of it."""
    found = ["bias", f"own:{holder.tag}", f"long:{min(MOST_BIN, len(text).bit_length())}", f"links:{round(4 * linked / len(text))}"]
    return [*found, "sentence"] if text[-1] in ".!?:;\"'»”…" else found


def score(text: str, linked: int, holder: Element, weights: dict[str, float] = PRIOR) -> float:
    """How much a block looks like content: the log-odds of the classifier, within its bound."""
    total = holder.score + sum(weights.get(f, 0.0) for f in text_features(text, linked, holder))
    return max(-MOST_SCORE, min(MOST_SCORE, total))


def labelled(page: str) -> list[tuple[list[str], int]]:
    """Features of a page's blocks, and whether they are content by the page's own marks; none if it has no marks.

    Each block counts a second time without what encloses it, so that its own text is learnt from as well."""
    found = blocks(page)
    if not any(holder.in_article for _, _, holder in found):
        return []
    out = []
    for text, linked, holder in found:
        features, x = text_features(text, linked, holder), holder
        while x is not None:
            features += x.own
            x = x.parent
        label = int(holder.in_article and not holder.aside)
        out += [(features, label), ([f for f in features if not f.startswith(("word:", "in:"))], label)]
    return out


def fit_rows(rows: list[tuple[list[str], int]], precision: float = PRECISION, steps: int = 300) -> dict[str, float]:
    """Weights of greatest posterior density under the prior: logistic regression by gradient steps
    of the bound on its curvature, with momentum."""
    names = {f: k for k, f in enumerate(dict.fromkeys(f for features, _ in rows for f in features))}
    if not rows:
        return PRIOR
    at = np.concatenate([[names[f] for f in features] for features, _ in rows])
    of = np.repeat(np.arange(len(rows)), [len(features) for features, _ in rows])
    y, mean = np.array([label for _, label in rows], float), np.array([PRIOR.get(f, 0.0) for f in names])
    uses, sizes = np.bincount(at, minlength=len(names)), np.bincount(of)
    # Each weight's step is bounded by what its rows can bend: the sum of their features' numbers, a quarter each.
    bend = 0.25 * np.bincount(at, weights=sizes[of], minlength=len(names)) + precision
    w = before = mean.copy()
    for k in range(steps if uses.size else 0):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, weights=ahead[at], minlength=len(y)), -30, 30)))
        slope = np.bincount(at, weights=(p - y)[of], minlength=len(names)) + precision * (ahead - mean)
        before, w = w, ahead - slope / bend
    return PRIOR | {f: float(w[k]) for f, k in names.items()}


def fit(pages: DataFrame, most: int = FIT_PAGES, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights fitted to at most `most` pages that mark their main text; the same for the same pages."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    marked = rows.where(F.lower("html").rlike("<(article|main)\\b")).select("page_id").where("page_id is not null").distinct()
    chosen = marked.orderBy(F.xxhash64("page_id"), "page_id").limit(most)  # bounded, so it may be broadcast

    def run(batches):
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = labelled(page or "")
                if found:
                    cols = [pa.array([page_id] * len(found), pa.int64()), pa.array([f for f, _ in found], pa.list_(pa.string())), pa.array([y for _, y in found], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["page_id", "features", "label"])

    found = map_batches(rows.join(F.broadcast(chosen), "page_id"), run, "page_id bigint, features array<string>, label int").distinct().collect()
    return fit_rows(sorted((r["features"], r["label"]) for r in found))


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[tuple[str, int, Element]]) -> dict[tuple[int, int], float]:
    """Smoothness edges between blocks."""
    joined: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for n, (_, _, holder) in enumerate(found):
        if n:
            joined[n - 1, n] = NEXT_EDGE / (1 + _distance(found[n - 1][2], holder))
        parent = holder.parent or holder
        if (before := last_of.get(id(parent))) is not None:
            joined[before, n] = joined.get((before, n), 0.0) + SIBLING_EDGE
        last_of[id(parent)] = n
    return joined


def minimum_cut(unary: list[float], joined: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling of least cost: which nodes stay with the source.

    unary: what a node pays for leaving the source less what it pays for staying;
    joined: what an edge pays when its ends are parted.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in joined.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    unary, label = list(unary), [None] * n
    work = list(range(n))
    while work:  # nodes whose own cost outweighs their edges
        x = work.pop()
        if label[x] is None and abs(unary[x]) > sum(near[x].values()):
            label[x] = unary[x] > 0
            for y, w in near[x].items():
                unary[y] += w if label[x] else -w
                del near[y][x]
                work.append(y)
            near[x] = {}
    rest = [x for x in range(n) if label[x] is None]
    if rest:
        side = _max_flow({x: unary[x] for x in rest}, {x: dict(near[x]) for x in rest})
        for x in rest:
            label[x] = side[x]
    return label


def _max_flow(unary: dict[int, float], residual: dict[int, dict[int, float]]) -> dict[int, bool]:
    """Augments along shortest paths until none is left; the source's side is what it still reaches."""
    from_source = {x: max(u, 0.0) for x, u in unary.items()}
    to_sink = {x: max(-u, 0.0) for x, u in unary.items()}
    tiny = 1e-12
    while True:
        came = {x: None for x, c in from_source.items() if c > tiny}
        queue, end = deque(came), None
        while queue:
            x = queue.popleft()
            if to_sink[x] > tiny:
                end = x
                break
            for y, c in residual[x].items():
                if c > tiny and y not in came:
                    came[y] = x
                    queue.append(y)
        if end is None:
            return {x: x in came for x in unary}
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        flow = min([from_source[path[0]], to_sink[end], *(residual[a][b] for a, b in zip(path, path[1:]))])
        from_source[path[0]] -= flow
        to_sink[end] -= flow
        for a, b in zip(path, path[1:]):
            residual[a][b] -= flow
            residual[b][a] = residual[b].get(a, 0.0) + flow


def _cost(x: float) -> float:
    """The logistic cost of a wrong label: log(1 + e**x)."""
    return x if x > 30 else math.log1p(math.exp(x))


def labels(found: list[tuple[str, int, Element]], weights: dict[str, float] = PRIOR) -> tuple[list[bool], list[float]]:
    """For each block whether the cut calls it content, and its score."""
    scores = [score(*b, weights) for b in found]
    # Leaving the source is to call a block boilerplate.
    return minimum_cut([_cost(s) - _cost(-s) for s in scores], edges(found)), scores


def main_text(page: str | None, weights: dict[str, float] = PRIOR) -> str:
    found = blocks(page or "", weights)
    return "\n\n".join(b[0] for b, content in zip(found, labels(found, weights)[0]) if content)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every row of `pages`; no shuffle. Without `weights` they are fitted to `pages`."""
    weights = fit(pages, id_col=id_col, html_col=html_col) if weights is None else weights
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(p, weights) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    return map_batches(rows, run, "page_id bigint, url string, text string")
