"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, staged, table

#: Fixed values of HTML: elements that stand as blocks, that have no end tag, whose content is
#: no markup, and that a start tag of the listed kinds ends.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes svg math object template".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
INSIDE_LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements, and words of classes, ids and roles, that mark what is never main text.
BOILER_TAGS = set("nav footer aside form header menu button select dialog fieldset search".split())
BOILER_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|recommend\w*|related|replies|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|main)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|$)|([^<]++|<)", re.S)
HINT = re.compile(r"\b(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
WHITE = re.compile(r"[\x20\x09-\x0D]+")

#: A node that is constant on so large a share of at least so many aligned pages is template.
CONSTANT, SUPPORT = 0.9, 2
#: Lists of siblings whose table of matches has more cells are matched by rows of numpy. This is for
#: speed alone: either way gives the same pairs.
CELLS = 4_000


class Page:
    """Block elements of a page as a tree, and its blocks of text in page order."""

    def __init__(self, source: str):
        self.tag, self.hint, self.parent, self.children = ["#page"], [""], [-1], [[]]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, run, at, end = [0], [], 0, len(source)
        tag, hint, parent, children = self.tag, self.hint, self.parent, self.children

        def close_run():
            if run:
                text = WHITE.sub(" ", html.unescape("".join(run))).strip(" ")
                if text:
                    self.blocks.append((stack[-1], text))
                run.clear()

        while at < end:
            m = TOKEN.match(source, at)
            at = m.end()
            if m[4] is not None:
                run.append(m[4])
                continue
            if m[2] is None:  # comments, declarations, cut-off tags
                continue
            name = m[2].lower()
            if m[1]:
                if name in BLOCKS:
                    for depth in range(len(stack) - 1, 0, -1):
                        if tag[stack[depth]] == name:
                            close_run()
                            del stack[depth:]
                            break
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else end
                if name in BLOCKS:
                    close_run()
                continue
            if name == "br":
                run.append(" ")
                continue
            if name not in BLOCKS:
                continue
            close_run()
            if name == "hr":
                continue
            if tag[stack[-1]] == "p":  # a block ends an open paragraph
                stack.pop()
            ends = ENDED_BY.get(name)
            if ends:
                for depth in range(len(stack) - 1, 0, -1):
                    if tag[stack[depth]] in INSIDE_LISTS[name]:
                        break
                    if tag[stack[depth]] in ends:
                        del stack[depth:]
                        break
            words = " ".join(x.strip("\"'") for x in HINT.findall(m[3])) if m[3] else ""
            above = stack[-1]
            tag.append(name), hint.append(words), parent.append(above), children.append([])
            children[above].append(len(tag) - 1)
            stack.append(len(tag) - 1)
        close_run()

    def boiler(self) -> list[bool]:
        """Whether a node is, or is inside, what its element or its names mark as no main text.
        A header inside an article belongs to the article."""
        out, article = [False], [False]
        for n in range(1, len(self.tag)):
            up = self.parent[n]
            own = self.tag[n] in BOILER_TAGS and not (self.tag[n] == "header" and article[up])
            if not own and self.hint[n] and self.tag[n] not in ("body", "html", "article", "main"):
                own = BOILER_WORDS.search(self.hint[n]) is not None
            out.append(out[up] or own)
            article.append(article[up] or self.tag[n] in ("article", "main"))
        return out

    def inside(self, roots: set[int]) -> list[bool]:
        out = [0 in roots]
        for n in range(1, len(self.tag)):
            out.append(out[self.parent[n]] or n in roots)
        return out

    def texts(self) -> dict[int, str]:
        """Own text of each node that has any."""
        own = defaultdict(list)
        for node, text in self.blocks:
            own[node].append(text)
        return {n: "\n".join(x) for n, x in own.items()}


def _shapes(*pages: Page) -> list[tuple[list[int], list[int], list[int]]]:
    """Of each node of the pages: a number of what is below it (0 if nothing is), one of the node with what is
    below it, and how many nodes that are. Equal numbers are equal elements and names all the way down."""
    known, out = {}, []
    for page in pages:
        tag, hint, children = page.tag, page.hint, page.children
        below, shape, size = [0] * len(tag), [0] * len(tag), [1] * len(tag)
        for n in range(len(tag) - 1, -1, -1):  # children come after their parents
            if children[n]:
                below[n] = known.setdefault(tuple([shape[c] for c in children[n]]), len(known) + 1)
                size[n] += sum([size[c] for c in children[n]])
            shape[n] = known.setdefault((tag[n], hint[n], below[n]), len(known) + 1)
        out.append((below, shape, size))
    return out


def _long_match(weights, n: int, m: int, which: bool) -> tuple[int, list[tuple[int, int]]]:
    """The best match in order of n siblings with m, by the weights of the i-th one with each of the m: its
    weight and, if asked for, its pairs. Of the table of n x m cells it holds a row in every sqrt(n)."""
    step, row, kept = math.isqrt(n), np.zeros(m + 1, np.int32), []

    def following(row, i):
        new = np.zeros(m + 1, np.int32)
        np.maximum(row[1:], row[:-1] + weights(i), out=new[1:])
        return np.maximum.accumulate(new)

    for i in range(n):
        if i % step == 0:
            kept.append(row)
        row = following(row, i)
    pairs, end, k = [], n, m
    while which and end and k:
        low = (end - 1) // step * step
        rows = [kept[low // step]]
        for i in range(low, end):
            rows.append(following(rows[-1], i))
        i = end - low
        while i and k:
            if rows[i][k] == rows[i - 1][k]:
                i -= 1
            elif rows[i][k] == rows[i][k - 1]:
                k -= 1
            else:
                i, k = i - 1, k - 1
                pairs.append((low + i, k))
        end = low
    return int(row[-1]), pairs


def align(a: Page, b: Page) -> dict[int, int]:
    """Simple tree matching: the largest set of node pairs with equal tags that keeps ancestors
    and the order of siblings, pairs of equal names counting twice; of equally large ones that of the earliest
    siblings. It is exact for any number of siblings and any depth. Returns node of a -> node of b.

    Siblings that are alike all the way down are paired from the front, as no other pair of theirs
    weighs more; the others meet in a table of n x m cells."""
    (below, shape, size), (other_below, other_shape, _) = _shapes(a, b)
    inner: dict[tuple[int, int], int] = {}  # weight of the best match below two nodes

    def weight(p: int, q: int) -> int:
        own, one, two = 1 + (a.hint[p] == b.hint[q]), below[p], other_below[q]
        if not one or not two:
            return own
        return own + (2 * (size[p] - 1) if one == two else inner[one, two])

    def long_weights(left: list[int], right: list[int]):
        """Row of weights of each of left, for many siblings; what is below is looked up once a kind of node."""
        kinds = {}
        kind = np.array([kinds.setdefault((b.tag[q], other_below[q]), len(kinds)) for q in right])
        names = {}
        tags, hints = (np.array([names.setdefault(x[q], len(names)) for q in right]) for x in (b.tag, b.hint))
        rows = {}

        def row(i: int) -> np.ndarray:
            p = left[i]
            if shape[p] not in rows:
                if len(rows) * len(right) > 8_000_000:
                    rows.clear()
                found = (tags == names.get(a.tag[p], -1)) * (1 + (hints == names.get(a.hint[p], -1)))
                if below[p]:
                    deep = [(2 * (size[p] - 1) if below[p] == two else inner[below[p], two]) if two and t == a.tag[p] else 0 for t, two in kinds]
                    found = found + np.array(deep)[kind]
                rows[shape[p]] = found.astype(np.int32)
            return rows[shape[p]]

        return row

    def apart(x: int, y: int) -> tuple[list[int], list[int], int]:
        """Children from the first ones on that differ in shape, and how many came before."""
        left, right, same = a.children[x], b.children[y], 0
        most = min(len(left), len(right))
        while same < most and shape[left[same]] == other_shape[right[same]]:
            same += 1
        return left[same:], right[same:], same

    def matched(x: int, y: int, which: bool) -> tuple[int, list[tuple[int, int]]]:
        """Weight of the best match of the children, and its pairs if asked for."""
        left, right, same = apart(x, y)
        pairs = [*zip(a.children[x][:same], b.children[y])]
        before = sum([2 * size[p] for p, _ in pairs])
        if len(left) * len(right) > CELLS:
            total, found = _long_match(long_weights(left, right), len(left), len(right), which)
            return before + total, pairs + [(left[i], right[k]) for i, k in found]
        rows = [[0] * (len(right) + 1)]
        for p in left:
            row, last = [0], rows[-1]
            for k, q in enumerate(right):
                best = last[k + 1] if last[k + 1] > row[k] else row[k]
                if a.tag[p] == b.tag[q]:
                    w = last[k] + weight(p, q)
                    if w > best:
                        best = w
                row.append(best)
            rows.append(row)
        i, k = len(left), len(right)
        while which and i and k:
            if rows[i][k] == rows[i - 1][k]:
                i -= 1
            elif rows[i][k] == rows[i][k - 1]:
                k -= 1
            else:
                i, k = i - 1, k - 1
                pairs.append((left[i], right[k]))
        return before + rows[-1][-1], pairs

    def weigh(x: int, y: int) -> None:
        """Fills `inner` for all that the match of the children of x and y asks for, deepest first."""
        waiting = [(x, y)]
        while waiting:
            x, y = waiting[-1]
            left, right, _ = apart(x, y)
            one = {(a.tag[p], below[p]): p for p in left if below[p]}
            two = {(b.tag[q], other_below[q]): q for q in right if other_below[q]}
            more = [(p, q) for (t, u), p in one.items() for (s, v), q in two.items() if t == s and u != v and (u, v) not in inner]
            if more:
                waiting += more
                continue
            waiting.pop()
            if (below[x], other_below[y]) not in inner:
                inner[below[x], other_below[y]] = matched(x, y, False)[0]

    pairs, waiting = {}, [(0, 0)]
    while waiting:
        x, y = waiting.pop()
        pairs[x] = y
        if below[x] and below[x] == other_below[y]:
            waiting += zip(a.children[x], b.children[y])
        elif below[x] and other_below[y]:
            if (below[x], other_below[y]) not in inner:
                weigh(x, y)
            waiting += matched(x, y, True)[1]
    return pairs


class Wrapper:
    """What a host's pages have in common, on the nodes of its reference page: constant nodes
    are template; the content region is the deepest node that holds all varying text (but what is
    marked as boilerplate)."""

    def __init__(self, reference: str, stats: list[tuple[int, int, int, int]]):
        self.page = Page(reference)
        self.constant, varying, self.region = set(), defaultdict(int), None
        boiler = self.page.boiler()
        pages = max((s[1] for s in stats), default=0)
        for node, matched, equal, size in stats:
            if matched >= SUPPORT and equal >= CONSTANT * matched:
                self.constant.add(node)
            elif not boiler[node]:
                varying[node] += size
        for node in range(len(self.page.tag) - 1, 0, -1):  # of a node with all below it
            if node in varying:
                varying[self.page.parent[node]] += varying[node]
        if pages >= SUPPORT and varying:
            most, at = varying[0], 0
            while True:
                deeper = [c for c in self.page.children[at] if varying.get(c, 0) == most and self.page.children[c]]
                if not deeper:
                    break
                at = deeper[0]
            self.region = at if at and self.page.tag[at] not in ("html", "body") else None

    def text(self, source: str) -> str:
        """The region's blocks. A page without it (or a host without a wrapper) gives the blocks
        of its article, else all blocks outside the template. Inside a region or an article constant
        blocks stay: a heading or list item that all pages share is part of their text."""
        page = Page(source)
        boiler, region, template = page.boiler(), None, set()
        if self.region is not None or self.constant:
            pairs = align(self.page, page)
            if self.region in pairs:
                region = {pairs[self.region]}
            own, same = page.texts(), self.page.texts()
            template = {pairs[n] for n in self.constant if n in pairs and own.get(pairs[n]) == same.get(n)}
        articles = {n for n, t in enumerate(page.tag) if t in ("article", "main") or (page.hint[n] and MAIN_WORDS.search(page.hint[n]) and t not in ("body", "html"))}
        articles = {n for n in articles if not boiler[n]}
        for roots, drop in ((region, set()), (articles, set()), ({0}, template)):
            if roots:
                inside = page.inside(roots)
                found = [t for n, t in page.blocks if inside[n] and not boiler[n] and n not in drop]
                if found:
                    return "\n".join(found)
        return ""


def host_column(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _stats(batches):
    """Of each host's reference nodes: pages on which they are aligned, on which their text is
    the same, and characters of other text there."""
    totals, last = defaultdict(lambda: [0, 0, 0]), (None, None)

    def rows():
        keys = list(totals)
        values = [*zip(*totals.values())] or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array(v, pa.int64()) for v in values)], ["host", "node", "matched", "equal", "chars"])

    for batch in slices(batches):
        for host, source, reference in zip(*(batch.column(k).to_pylist() for k in ("host", "html", "reference"))):
            if last[0] != host:
                page = Page(reference)
                last = (host, page, page.texts())
            other = Page(source or "")
            pairs, own = align(last[1], other), other.texts()
            for node, text in last[2].items():
                if node in pairs:
                    total, there = totals[host, node], own.get(pairs[node], "")
                    total[0] += 1
                    total[1] += there == text
                    total[2] += 0 if there == text else len(there)
        if len(totals) > 200_000:
            yield rows()
            totals.clear()
    yield rows()


def _extract(carried):
    def run(batches):
        wrappers: dict[str, Wrapper] = {}
        for batch in slices(batches):
            out = []
            for host, source, reference, stats in zip(*(batch.column(k).to_pylist() for k in ("host", "html", "reference", "stats"))):
                if host not in wrappers:
                    if len(wrappers) >= 200:
                        wrappers.clear()
                    wrappers[host] = Wrapper(reference or "", [(s["node"], s["matched"], s["equal"], s["chars"]) for s in stats or ()])
                out.append(wrappers[host].text(source or ""))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*carried, "text", "n_chars"])

    return run


def main_text(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html", order: str = "page_id", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """`keep` columns, text and n_chars of every page.

    The reference page of a host is its first one in the order of `order` and of the page itself,
    empty pages last.
    All pages of the host are aligned with it; how often each of its nodes stays the same gives
    the template and the content region, and a second pass takes the region's blocks. Hosts of
    few pages have no wrapper; their article (or what isn't marked as boilerplate) is taken. A
    null page is empty and gives an empty text; a null URL has the host ''. Repeated rows each
    keep their row; an empty table gives none. Reference pages are broadcast up to
    broadcast_bytes in all, else pages and references meet in a shuffle.
    """
    kinds = dict(pages.dtypes)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(k).alias(n) for k, n in zip(keep, names)), host_column(F.col(url)).alias("host"), F.col(source).alias("html"), F.col(order).alias("order"))
    # Of equally early pages the least text; a struct minimum keeps one row a task and host.
    first = rows.groupBy("host").agg(F.min(F.struct((~F.coalesce(F.col("html").rlike("\\S"), F.lit(False))).alias("empty"), F.isnull("order").alias("none"), "order", F.coalesce("html", F.lit("")).alias("html"))).alias("first"))
    references = staged(first.select("host", F.col("first.html").alias("reference")), "references")
    size = references.agg(F.coalesce(F.sum(F.octet_length("reference") + 64), F.lit(0))).first()[0]
    hint = F.broadcast if size <= broadcast_bytes else (lambda df: df)
    counts = rows.select("host", "html").join(hint(references), "host").mapInArrow(_stats, "host string, node int, matched long, equal long, chars long")
    counts = counts.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("matched", "equal", "chars")))
    stats = counts.groupBy("host").agg(F.collect_list(F.struct("node", "matched", "equal", "chars")).alias("stats"))
    wrappers = staged(references.join(stats, "host", "left"), "wrappers")
    release(pages.sparkSession)
    out = rows.drop("order").join(hint(wrappers), "host").mapInArrow(_extract(names), ", ".join([*(f"{n} {kinds[k]}" for k, n in zip(keep, names)), "text string, n_chars long"]))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names)), "text", "n_chars")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
