"""HTML extraction by tag-path ratios.

A page is read into text nodes, each with its path of block tags from root to leaf. Of each path the
logarithms of text length and punctuation a node are taken, so that no long block outvotes the rest;
the two ratios are smoothed along the page and fused with those before smoothing. The fused ratios are
summed over subtrees to choose the content's region: an article or main part whose share of the page's
sum, or mean, is not clearly below the page's, else the subtree that nearly all of the sum is in.
Of the region, paths whose ratio is not below a share of the page's median hold the content: in an
article or main part any path that is not clearly below, as nothing but a low ratio speaks against
its text. Names and roles of elements weigh in as factors of ratios; tags that stand for menus, headers,
footers, asides and forms are left out below the region, but nothing leaves out what holds most of it.
A page is read in time and memory linear in its length (but for one sort of its nodes).
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_OPEN = re.compile(r"</?[a-zA-Z][^<]*$")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements without text of the page, and those that are parts of a page other than its content.
_SKIP = set("script style textarea title noscript iframe xmp head button select option datalist template svg canvas object audio video input".split())
_PARTS = set("nav header footer aside form menu dialog fieldset".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: Names of elements that hardly are an article's, as a whole name or with words that say nothing; words that some article's names have too.
_CLEAR = r"ads?|adv|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|newsletter|subscribe|subscription|comments?|commentlist|disqus|sidebar|breadcrumbs?|pagination|pager|login|signup|signin"
_NEUTRAL = r"list|section|box|area|wrap|wrapper|container|block|item|post|page|inner|outer|top|bottom|left|right|main|slot|unit|banner|bar|body|thread|form|notice|popup|\d+"
_CLEAR_NAME = re.compile(rf"(?:^|\s)(?:(?:{_NEUTRAL})[_-]+)*(?:{_CLEAR})(?:[_-]+(?:{_NEUTRAL}))*(?:$|\s)", re.IGNORECASE)
_NAME = re.compile(rf"(?:^|[\s_-])(?:{_CLEAR}|promo\w*|popup|overlay|modal|nav\w*|share|sharing|social|related|recommend\w*|widget|toolbar|banner|notices?|notification|side|rail|menu|footer|foot|header|masthead|topbar|reply|replies|respond|discussion|search|copyright|legal|disclaimer|skip)(?:$|[\s_-])", re.IGNORECASE)
#: Factors of a ratio: of what stands in a part or has a name, in the choice of the region and in one without an article; of a clear name, another name and none in an article.
_ODD, _IN_CLEAR, _IN_NAMED, _IN_ARTICLE = 0.15, 0.15, 0.4, 4.0
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")


class _Block:
    __slots__ = ("path", "leaf", "element", "parts", "linked")

    def __init__(self, path: int, leaf: str, element: int):
        self.path, self.leaf, self.element, self.parts, self.linked = path, leaf, element, [], 0


class _Open:
    """An open element: its path and the block element nearest to it, and what holds of its text."""

    __slots__ = ("tag", "path", "leaf", "skipped", "linked", "element")

    def __init__(self, tag: str, path: int, leaf: str, skipped: bool, linked: bool, element: int):
        self.tag, self.path, self.leaf, self.skipped, self.linked, self.element = tag, path, leaf, skipped, linked, element


class Elements:
    """The block elements of a page in page order, the page itself first. Of each: its parent, and the innermost of each kind
    among it and those around it (0: none): article or main part, other part, clear name, any name."""

    def __init__(self):
        self.parent, self.article, self.part, self.clear, self.named, self.tags = [0], [0], [0], [0], [0], [""]

    def add(self, above: int, tag: str, article: bool, part: bool, clear: bool, named: bool) -> int:
        n = len(self.parent)
        self.parent.append(above)
        self.tags.append(tag)
        for kind, own in ((self.article, article), (self.part, part), (self.clear, clear), (self.named, named)):
            kind.append(n if own else kind[above])
        return n


def _tokens(page: str):
    """(start, end, name, closing, attributes) of each tag, and of what is no text with an empty name; behind the last > there are comments alone.

    Attributes end at the first > outside quotes; once quotes stay open to the end of the page, at any >.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if at > last and (at := page.find("<!--", at)) < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.index(">", at) + 1
            yield at, end, "", False, ""
        elif m := _TAG.match(page, at):
            rest = _REST.match(page, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.index(">", m.end()) + 1
            sent = yield at, end, m[1].lower(), page[at + 1] == "/", page[m.end() : end - 1]
            end = sent or end
        else:
            end = at + 1
        at = end


def blocks(page: str) -> tuple[list[_Block], list[int], Elements]:
    """Blocks of text in page order, the parent of each path, and the page's elements.

    A path is a number: that of its parent and its last step.
    """
    out: list[_Block] = []
    paths, parents = {}, [0]
    elements = Elements()
    stack = [_Open("", 0, "", False, False, 0)]
    counts: dict[str, int] = defaultdict(int)
    now: _Block | None = None
    done = 0

    def text(raw: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.skipped:
            return
        if now is None:
            if not raw.strip():
                return
            now = _Block(top.path, top.leaf, top.element)
            out.append(now)
        now.parts.append(raw)
        if top.linked:
            now.linked += len(raw.strip())

    def close(i: int) -> None:
        for x in stack[i:]:
            counts[x.tag] -= 1
        del stack[i:]

    found = _tokens(page)
    jump = None
    while True:
        try:
            start, end, tag, closing, told = found.send(jump)
        except StopIteration:
            break
        jump = None
        if start > done:
            text(page[done:start])
        done = end
        if not tag:
            continue
        if closing:
            if counts[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            if tag not in _INLINE:
                now = None
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag not in _INLINE:
            now = None
            if tag in _CLOSES:
                ends, bound = _CLOSES[tag]
                if any(counts[x] > 0 for x in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in bound:
                            break
                        if stack[i].tag in ends:
                            close(i)
                            break
            elif counts["p"] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag not in _INLINE and stack[i].tag not in _HEADINGS:
                        break
        if tag in _VOID:
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(told)} if "=" in told else {}
        above = stack[-1]
        role = attrs.get("role")
        skipped = above.skipped or tag in _SKIP or attrs.get("aria-hidden") == "true" or bool(re.search(r"(?:^|\s)hidden(?:$|[\s=/])", told)) or "display:none" in attrs.get("style", "").replace(" ", "")
        if tag in _RAW:
            over = _RAW[tag].search(page, end)
            done = jump = over.end() if over else len(page)
        elif not told.rstrip().endswith("/") or tag in _INLINE:
            path, leaf, element = above.path, above.leaf, above.element
            if tag not in _INLINE:
                step = f"{tag}.{attrs['class'].split()[0]}" if attrs.get("class", "").strip() else tag
                path, leaf = paths.setdefault((above.path, step), len(parents)), tag
                if path == len(parents):
                    parents.append(above.path)
                article = tag in ("article", "main") or role == "main" or attrs.get("itemprop") == "articleBody"
                part = not article and (role in _ROLES or tag in _PARTS and not (tag == "header" and elements.article[above.element]))
                name = f"{attrs.get('class', '')} {attrs.get('id', '')}" if tag not in ("html", "body") else ""
                clear = len(name) > 1 and bool(_CLEAR_NAME.search(name))
                element = elements.add(above.element, tag, article and not clear, part, clear, clear or len(name) > 1 and not article and bool(_NAME.search(name)))
            stack.append(_Open(tag, path, leaf, skipped, above.linked or tag == "a", element))
            counts[tag] += 1
    if done < len(page):
        text(_OPEN.sub("", page[done:]))  # a tag that never ends is no text
    return out, parents, elements


def _smooth(values: list[float]) -> list[float]:
    """A short Gaussian along the page."""
    n = len(values)
    out = []
    for i in range(n):
        near = [(values[j], w) for j, w in ((i - 1, 0.25), (i, 0.5), (i + 1, 0.25)) if 0 <= j < n]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def _ratios(nodes: list[tuple[_Block, str]]) -> tuple[dict[int, float], set[int]]:
    """The fused ratio of each path, and the paths that are mostly links."""
    length, punctuation, linked, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b, t in nodes:
        length[b.path] += len(t)
        punctuation[b.path] += len(_PUNCTUATION.findall(t))
        linked[b.path] += b.linked
        count[b.path] += 1
    lengths = {p: log1p(length[p] / count[p] / 16) for p in count}
    marks = {p: log1p(punctuation[p] / count[p]) for p in count}
    by_length = _smooth([lengths[b.path] for b, _ in nodes])
    by_marks = _smooth([marks[b.path] for b, _ in nodes])
    fused: dict[int, float] = defaultdict(float)
    for (b, _), x, y in zip(nodes, by_length, by_marks, strict=True):
        fused[b.path] += ((lengths[b.path] + marks[b.path]) * (x + y)) ** 0.5 / count[b.path]
    return fused, {p for p in fused if linked[p] > 0.5 * length[p]}


def _median(ratios: list[float]) -> float:
    """The median of the blocks, each with its ratio as its weight."""
    below, half, v = 0.0, sum(ratios) / 2, 0.0
    for v in sorted(ratios):
        below += v
        if below >= half * (1 - 1e-12):
            break
    return v


class _Sums:
    """Sums of ratios over the subtree of each element: with factors, without, and their number."""

    def __init__(self, elements: Elements, at: list[int], ratios: list[float], factors: list[float]):
        n = len(elements.parent)
        self.mass, self.raw, self.count, self.end = [0.0] * n, [0.0] * n, [0] * n, [i + 1 for i in range(n)]
        self.best, self.largest = [0] * n, [0] * n  # the child with the largest sum with factors, and without
        for i, v, f in zip(at, ratios, factors, strict=True):
            self.mass[i] += v * f
            self.raw[i] += v
            self.count[i] += 1
        for i in range(n - 1, 0, -1):
            up = elements.parent[i]
            self.mass[up] += self.mass[i]
            self.raw[up] += self.raw[i]
            self.count[up] += self.count[i]
            self.end[up] = max(self.end[up], self.end[i])
            for x, sums in ((self.best, self.mass), (self.largest, self.raw)):
                if not x[up] or sums[i] >= sums[x[up]]:
                    x[up] = i


def _regions(elements: Elements, sums: _Sums, least: float) -> tuple[list[int], bool]:
    """The elements that hold the content, in page order, and whether they are articles or main parts; least: the mean ratio that is enough."""
    inner = defaultdict(list)
    for i, own in enumerate(elements.article):
        if own == i and i:
            inner[elements.article[elements.parent[i]]].append(i)
    region, marked = 0, False
    while not marked or elements.tags[region] != "article":
        able = [i for i in inner[region] if sums.mass[i] > 0 and (sums.mass[i] >= 0.15 * sums.mass[region] or sums.mass[i] >= least * sums.count[i])]
        if not able:
            break
        best = max(able, key=lambda i: sums.mass[i])
        if sums.mass[best] < 0.5 * sum(sums.mass[i] for i in able):
            return [i for i in able if sums.mass[i] >= 0.25 * sums.mass[best]], True
        region, marked = best, True
    while not marked and (child := sums.best[region]) and sums.mass[child] >= 0.8 * sums.mass[region] and sums.mass[region] > 0:
        region = child
    return [region], marked


def main_text(page: str | None, threshold: float = 0.2) -> str:
    """The article's blocks, joined by \\n; white space in a block is one space. Empty if there is none."""
    nodes = []
    found, parent, elements = blocks(page or "")
    for b in found:
        joined = " ".join(html.unescape("".join(b.parts)).split())
        if joined:
            nodes.append((b, joined))
    if not nodes:
        return ""
    fused, links = _ratios(nodes)
    at, ratios = [b.element for b, _ in nodes], [fused[b.path] for b, _ in nodes]
    factors = [_ODD if elements.part[i] or elements.named[i] else 1.0 for i in at]
    sums = _Sums(elements, at, ratios, factors)
    middle = _median([v * f for (b, _), v, f in zip(nodes, ratios, factors, strict=True) if b.path not in links])
    regions, marked = _regions(elements, sums, 2.5 * threshold * middle)
    allowed, k = set(), 0
    inside: list[tuple[_Block, str, float, int]] = []
    for region in regions:
        # parts that hold most of a region are none
        i = region
        while sums.largest[i] and sums.raw[sums.largest[i]] >= 0.5 * sums.raw[region]:
            i = sums.largest[i]
            allowed.add(i)
    for (b, t), v in zip(nodes, ratios, strict=True):
        i = b.element
        while k < len(regions) and i >= sums.end[regions[k]]:
            k += 1
        if k == len(regions):
            break
        region = regions[k]
        if i < region or elements.part[i] > region and elements.part[i] not in allowed:
            continue
        inside.append((b, t, v, region))
    # against the region's own median
    middle = _median([v * (_ODD if elements.named[b.element] > region else 1.0) for b, _, v, region in inside if b.path not in links])
    kept, beside = [], set()
    for b, t, v, region in inside:
        i = b.element
        named = elements.named[i] > region
        if marked:
            factor = _IN_CLEAR if elements.clear[i] > region else _IN_NAMED if named else _IN_ARTICLE
        else:
            factor = 0.0 if b.path in links else _ODD if named else 1.0
        holds = v * factor >= threshold * middle and factor > 0
        kept.append((t, holds, parent[b.path] if not marked and factor == 1.0 and b.leaf in _HEADINGS else -1))
        if holds:
            beside.add(parent[b.path])
    return "\n".join(t for t, holds, heading in kept if holds or heading in beside)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.2) -> DataFrame:
    """page_id, url, text, n_chars (code points), a row for each row of pages.

    Null and empty pages, and pages of markup alone, have an empty text. Repeated rows stay; other
    columns are not read. Pages are read whole, one by one, and nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x, threshold) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
