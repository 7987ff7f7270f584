"""Main text of HTML pages by wrappers, inferred per host as union-free regular expressions.

The token streams of a few pages of a host are aligned one after the other. Runs of like elements
become repeated groups, what only some pages have becomes optional, strings that differ between pages
become text slots and strings that agree stay template text. The result is one expression without
alternatives: elements in order, each plain, optional (?) or repeated (+), with slots (#TEXT).

In the wrapper every group gets its part. The main group is a main or article element, else the smallest element that
holds all text once menus, headers, footers, sidebars, notices, adverts, forms and reader comments are set
aside. Groups are set aside by their element; by names that mean nothing else (comments, cookie-notice); and
by what the wrapper shows of them: text that is all links, or, where nothing names the main element, text that all pages of the
host agree on. Names that an article's own parts may bear (related, search, footer) only add to
that: within a named main element they count with such a sign alone. Every page of the host is matched against the
expression, and the text of its groups within the main one is read in page order, apart from those set aside;
what the expression doesn't foresee there is read as well. A page that has no main group is read by the
wrapper of that page alone.

The wrapper of a host is inferred from at most ``SAMPLE_PAGES`` of its pages (those of lowest hash of
url and page_id), however many it has. All pages are extracted, from their whole html. Nothing recurses by the depth of a page.

Defined cases: a null html has the text ''; a null url, or one without a host, belongs to the host '';
pages without any main text have ''; equal pages of a host get equal texts, so repeated rows do, and ties in
the sample's hash are broken by the html; very long and very deep pages are read whole; an empty table gives
an empty one; columns of the input that are named text, host or wrapper are replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechmill.llm.common import staged, table, without

SAMPLE_PAGES = 12
#: Bytes of wrappers that may be broadcast; more are joined by host.
BROADCAST_BYTES = 4 << 20
#: Share of the text of a main element from which on an article in it is preferred, if it leaves no heading outside.
MOST_TEXT = 0.9
#: Share of links in the text of a group from which on it is a list of links, and from which on its name counts.
ALL_LINKS, SOME_LINKS = 0.9, 0.5
#: Cells of an alignment; longer lists of children are matched in order of appearance.
CELLS = 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn em font i kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_OWN_KIND = set("p li tr td th dt dd option".split())
ASIDE_TAGS = set("nav header footer aside form button select dialog menu head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Never set aside by a name.
KEPT_TAGS = HEADINGS | {"html", "body", "main", "article"}
MAIN_TAGS = ("article", "main")
_PLAIN = "area|list|section|wrap(?:per)?|container|box|block|bar|form|respond|title|inner|policy|message|overlay|slot|unit|site|page|main|top|bottom|left|right|primary|secondary|[0-9]+"
_SURE = "ads?|advert\\w*|sponsor\\w*|promo\\w*|cookies?|consent|popup|modal|sidebar|comments?|commentlist|replies|disqus|newsletter|subscribe"
_VAGUE = "banner|notices?|menu|nav\\w*|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\\w*|login|search|widget|toolbar|pagination|pager"


def _names(some: str, others: str) -> re.Pattern:
    """Names of pieces parted by - or _, each of them known and one at least of ``some``."""
    return re.compile(rf"(?=.*?(?:^|[_-])(?:{some})(?:$|[_-]))(?:(?:^|[_-])(?:{some}|{others}|{_PLAIN})(?=$|[_-]))+", re.I)


SURE_NAMES, VAGUE_NAMES = _names(_SURE, _VAGUE), _names(_VAGUE, _VAGUE)
PLAIN, ASIDE, MAIN = 0, 1, 2


def unwound(f: Callable) -> Callable:
    """A recursive function, written as a generator that yields the arguments of its own calls, on a stack
    that isn't Python's: it goes as deep as pages do."""

    def call(*args):
        calls, value = [f(*args)], None
        while calls:
            try:
                args = calls[-1].send(value)
            except StopIteration as done:
                calls.pop()
                value = done.value
            else:
                calls.append(f(*args))
                value = None
        return value

    return call


class Node:
    """An element of a page or of a wrapper, or a text (key '#TEXT')."""

    __slots__ = ("key", "children", "text", "optional", "repeated", "slot", "weight", "links", "n_links", "heading", "said", "pages", "role")

    def __init__(self, key: str, text: str = ""):
        self.key, self.text, self.children = key, text, []
        self.optional = self.repeated = self.slot = self.heading = False
        self.weight = self.links = self.n_links = self.role = 0
        self.said, self.pages = None, 1

    @property
    def tag(self) -> str:
        return self.key.split(" ", 1)[0]

    def measure(self) -> None:
        """Characters of text, those of them in links, the number of links, and whether there is a heading."""
        tag = self.tag
        if self.key == "#TEXT":
            self.weight = self.weight or len(self.text.strip())
            return
        self.weight = sum(c.weight for c in self.children)
        self.links = self.weight if tag == "a" else sum(c.links for c in self.children)
        self.n_links = 1 if tag == "a" else sum(c.n_links for c in self.children)
        self.heading = tag in HEADINGS or any(c.heading for c in self.children)


def parse(html: str) -> Node:
    """The elements of a page. An element that is never closed ends before the next one of its kind, or
    where an element around it ends."""
    root = Node("#ROOT")
    stack, tags = [root], ["#ROOT"]
    open_tags: Counter = Counter()

    def close(k: int) -> None:
        for t in tags[k:]:
            open_tags[t] -= 1
        del stack[k:], tags[k:]

    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            if text.strip() or (stack[-1].children and text):
                stack[-1].children.append(Node("#TEXT", text))
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if open_tags[name]:
                close(len(tags) - 1 - tags[::-1].index(name) if tags[-1] != name else len(tags) - 1)
            continue
        names = " ".join(next(filter(None, a.groups()[1:]), "") for a in _ATTR.finditer(m["attrs"])) if m["attrs"] else ""
        node = Node(f"{name} {_SPACE.sub(' ', names).strip()}".strip())
        if name in CLOSES_OWN_KIND and open_tags[name]:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == name:
                    close(k)
                    break
                if tags[k] not in INLINE and tags[k] != "p":
                    break
        stack[-1].children.append(node)
        if name not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
            tags.append(name)
            open_tags[name] += 1
    return root


# --- inference -------------------------------------------------------------------------------------


@unwound
def generalise(node: Node):
    """A page's element as a wrapper: runs of elements of one key become a repeated group."""
    out = Node(node.key, _SPACE.sub(" ", entities.unescape(node.text)).strip() if node.key == "#TEXT" else "")
    said = [out.text]
    for child in node.children:
        if child.key == "#TEXT" and not child.text.strip():
            continue
        new = yield (child,)
        said.append(new.said)
        if out.children and out.children[-1].key == new.key:
            out.children[-1] = align(out.children[-1], new, True)
        else:
            out.children.append(new)
    out.said = hash(tuple(said))
    out.measure()
    return out


def matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal keys in order, as many as possible unless the lists are very long."""
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    b = 0
    while b < min(len(x), len(y)) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    head = [(k, k) for k in range(a)]
    tail = [(len(x) - b + k, len(y) - b + k) for k in range(b)]
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    middle, i, j = [], 0, 0
    if len(x) * len(y) > CELLS:
        places: dict[str, list[int]] = {}
        for k, key in enumerate(y):
            places.setdefault(key, []).append(k)
        for i, key in enumerate(x):
            at = bisect_left(places.get(key, []), j)
            if at < len(places.get(key, [])):
                middle.append((i, places[key][at]))
                j = places[key][at] + 1
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return head + [(i + a, j + a) for i, j in middle] + tail


@unwound
def align(a: Node, b: Node, within: bool = False):
    """The wrapper of both: matching elements merge, mismatches become optional or text slots.
    within: both are of one page, neighbours of a repeated group."""
    out = Node(a.key)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated or within
    out.pages = max(a.pages, b.pages) if within else a.pages + b.pages
    out.said = hash((a.said, b.said)) if within else a.said if a.said == b.said else None
    out.heading = a.heading or b.heading
    out.weight, out.links, out.n_links = a.weight + b.weight, a.links + b.links, max(a.n_links, b.n_links) + (within and min(a.n_links, b.n_links))
    if a.key == "#TEXT":
        out.slot = a.slot or b.slot or a.text != b.text
        out.text = "" if out.slot else a.text
        return out
    x, y = a.children, b.children
    i = j = 0
    for k, l in [*matches([c.key for c in x], [c.key for c in y]), (len(x), len(y))]:
        found = [*x[i:k], *y[j:l]]
        for node in found:
            node.optional = True
        if k < len(x):
            found.append((yield (x[k], y[l], within)))
        for node in found:
            if out.children and out.children[-1].key == node.key:
                out.children[-1] = yield (out.children[-1], node, True)
            else:
                out.children.append(node)
        i, j = k + 1, l + 1
    return out


@unwound
def expression(node: Node):
    """The wrapper as a union-free regular expression over tags and text slots."""
    if node.key == "#TEXT":
        body = "#TEXT" if node.slot or node.repeated else json.dumps(node.text, ensure_ascii=False)
    else:
        parts = []
        for c in node.children:
            parts.append((yield (c,)))
        body = "".join(parts) if node.key == "#ROOT" else f"<{node.key}>{''.join(parts)}</{node.tag}>"
    if node.repeated:
        body = f"({body})+"
    return f"({body})?" if node.optional else body


class Parts:
    """Which groups of a wrapper are set aside. pages: how many different pages it was inferred from;
    named: whether the group looked at is within an element that is named as the main one."""

    def __init__(self, root: Node, pages: int):
        self.pages = pages
        # that all pages agree on a text tells of the site only if they differ in more than they agree
        agreed = differing = 0
        if pages > 1:
            todo = list(root.children)
            while todo:
                n = todo.pop()
                if self._agreed(n):
                    agreed += n.weight
                elif n.key == "#TEXT":
                    differing += n.weight
                todo += [] if self._agreed(n) else n.children
        self.tells = differing > agreed

    def _agreed(self, n: Node) -> bool:
        return n.pages >= self.pages and n.said is not None and not n.optional

    def aside(self, n: Node, named: bool) -> bool:
        tag, _, names = n.key.partition(" ")
        if tag in ASIDE_TAGS:
            return not (tag == "header" and n.heading)
        if tag in KEPT_TAGS or tag == "a":
            return False
        names = names.split(" ")
        if any(SURE_NAMES.fullmatch(x) for x in names):
            return True
        agreed = self.pages > 1 and self.tells and self._agreed(n) and n.weight > 0
        if any(VAGUE_NAMES.fullmatch(x) for x in names) and not n.heading:
            return not named or agreed or n.links >= SOME_LINKS * n.weight
        if named:
            return False
        return agreed or (tag not in INLINE and tag != "p" and n.n_links > 1 and n.links >= ALL_LINKS * n.weight > 0)

    def text(self, root: Node, links: bool = False, named: bool = False) -> int:
        """The text of an element without what is set aside, and without links unless they count."""
        total, todo = 0, [root]
        while todo:
            n = todo.pop()
            if n.key == "#TEXT":
                total += n.weight
            elif n is root or not (self.aside(n, named) or (n.tag == "a" and not links)):
                todo += n.children
        return total

    def has_heading(self, root: Node, but: Node) -> bool:
        todo = [root]
        while todo:
            n = todo.pop()
            if n is but or (n is not root and self.aside(n, True)):
                continue
            if n.tag in HEADINGS and n.weight:
                return True
            todo += n.children
        return False


def assign(root: Node, pages: int) -> bool:
    """Gives every group its role; whether the main one is named as such."""
    parts = Parts(root, pages)
    named: list[tuple[Node, Node]] = []  # main or article elements and what they are in
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n.children:
            if c.key == "#TEXT" or parts.aside(c, True):
                continue
            if c.tag in MAIN_TAGS or "main" in c.key.split(" ")[1:]:
                named.append((c, n))
            todo.append(c)
    weighed = [(w, c, n) for c, n in named if (w := parts.text(c, named=True))]
    if weighed:
        most = max(w for w, _, _ in weighed)
        outer = next(c for w, c, _ in weighed if w == most)
        inner = [x for x in weighed if x[1].tag == "article" and x[0] >= MOST_TEXT * most and (x[1] is outer or not parts.has_heading(outer, x[1]))]
        _, chosen, around = max(inner or [x for x in weighed if x[0] == most], key=lambda x: x[0])
        for c in around.children:  # several articles side by side
            if c is chosen or (chosen.tag in MAIN_TAGS and c.tag == chosen.tag):
                c.role = MAIN
    elif parts.text(root):
        node = root
        while True:  # down only while nothing that isn't set aside is left outside, links included
            full = [c for c in node.children if (c.key == "#TEXT" and c.weight) or (c.key != "#TEXT" and not parts.aside(c, False) and parts.text(c, links=True))]
            if len(full) != 1 or full[0].key == "#TEXT" or full[0].repeated or full[0].tag in INLINE or full[0].tag == "p":
                break
            node = full[0]
        node.role = MAIN
    todo = [(root, root.role == MAIN)]
    while todo:
        n, inside = todo.pop()
        for c in n.children:
            if c.key != "#TEXT":
                if inside and c.role != MAIN and parts.aside(c, bool(weighed)):
                    c.role = ASIDE
                elif c.role == MAIN or inside or not weighed or c.tag not in ASIDE_TAGS:
                    todo.append((c, inside or c.role == MAIN))
    return bool(weighed)


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host: its groups in page order as [number of the group around, key,
    role], whether the main one is named, and the expression."""
    distinct = list(dict.fromkeys(pages))
    wrapper = None
    for p in distinct:
        page = generalise(parse(p))
        wrapper = page if wrapper is None else align(wrapper, page)
    if wrapper is None:
        return {"groups": [], "named": False, "expression": ""}
    named = assign(wrapper, len(distinct))
    groups: list[list] = []
    todo = [(wrapper, -1)]
    while todo:
        n, around = todo.pop()
        me = len(groups)
        groups.append([around, n.key, n.role])
        if n.role != ASIDE:
            todo += [(c, me) for c in reversed(n.children) if c.key != "#TEXT"]
    return {"groups": groups, "named": named, "expression": expression(wrapper)}


# --- extraction ------------------------------------------------------------------------------------


class Wrapper:
    """A wrapper ready to be matched with pages."""

    def __init__(self, told: dict):
        self.role = [g[2] for g in told["groups"]]
        self.named = told["named"]
        self.within: list[dict[str, list[tuple[int, int]]]] = [{} for _ in self.role]  # of each group, by key: places and numbers
        n_within = [0] * len(self.role)
        for k, (around, key, _) in enumerate(told["groups"]):
            if around >= 0:
                self.within[around].setdefault(key, []).append((n_within[around], k))
                n_within[around] += 1
        self.own = Parts(Node("#ROOT"), 1)

    def match(self, group: int, children: list[Node]) -> list[int]:
        """The groups of the wrapper that children of a page's element belong to, in order; -1: none."""
        out, at = [], 0
        within = self.within[group] if group >= 0 else {}
        for c in children:
            places = within.get(c.key)
            if not places:
                out.append(-1)
                continue
            k = min(bisect_left(places, (at, -1)), len(places) - 1)
            at = max(at, places[k][0])
            out.append(places[k][1])
        return out

    def read(self, page: Node) -> list[str] | None:
        """The blocks of the main groups of a page in page order; inline elements don't part a block. None
        without a main group."""
        out: list[str] = []
        run: list[str] = []
        found = False

        def flush() -> None:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

        first = bool(self.role) and self.role[0] == MAIN
        todo: list[tuple[Node | None, int, bool]] = [(page, 0 if self.role else -1, first)]
        found = first
        while todo:
            n, group, inside = todo.pop()
            if n is None:  # the end of a block
                flush()
                continue
            if n.key == "#TEXT":
                run.append(n.text)
                continue
            block = n.tag not in INLINE
            if inside and block:
                flush()
                todo.append((None, -1, True))
            if n.tag == "br":
                run.append(" ")
            unknown = inside and group < 0
            for c, g in reversed(list(zip(n.children, self.match(group, n.children)))):
                if c.key == "#TEXT":
                    if inside:
                        todo.append((c, -1, True))
                    continue
                if g >= 0:
                    role = self.role[g]
                    if role == ASIDE:
                        if inside and c.tag not in INLINE:
                            todo.append((None, -1, True))
                        continue
                    if role == MAIN and not inside:
                        found = True
                        todo.append((None, -1, True))
                        todo.append((c, g, True))
                        continue
                elif inside:
                    if not unknown:
                        measured(c)
                    if self.own.aside(c, self.named):
                        if c.tag not in INLINE:
                            todo.append((None, -1, True))
                        continue
                else:
                    continue  # nothing that the wrapper knows of
                todo.append((c, g, inside))
        flush()
        return out if found else None


def measured(root: Node) -> None:
    """Measures all elements of a part of a page."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.children
    for n in reversed(order):
        n.measure()


def extract(html: str | None, wrapper: Wrapper | dict | None) -> str:
    """The main text of one page by the wrapper of its host."""
    if not html:
        return ""
    page = parse(html)
    if isinstance(wrapper, dict):
        wrapper = Wrapper(wrapper)
    blocks = wrapper.read(page) if wrapper else None
    if blocks is None:
        blocks = Wrapper(infer([html])).read(page)
    return "\n\n".join(blocks or [])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return without(pages, "host").withColumn("host", host)


def wrappers(pages: DataFrame, per_host: int = SAMPLE_PAGES) -> DataFrame:
    """(host, wrapper, expression): the groups as JSON. The sample is thinned where it is read, then by host."""
    some = _with_host(pages).where("html is not null").select("host", "html", F.xxhash64("url", "page_id").alias("o"), (F.spark_partition_id() % 32).alias("part"))
    for keys in (["host", "part"], ["host"]):
        w = Window.partitionBy(*keys).orderBy("o", "html")
        some = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_host).drop("k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "html"])
        told = infer(pdf["html"].tolist())
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps({k: told[k] for k in ("groups", "named")}, ensure_ascii=False)], "expression": [told["expression"]]})

    return some.select("host", "o", "html").groupBy("host").applyInPandas(run, "host string, wrapper string, expression string")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html and others) with ``text``, the main text of each page."""
    pages = without(pages, "text", "host", "wrapper")
    learned = staged(wrappers(pages).select("host", "wrapper"), "wrappers")
    size = learned.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    joined = _with_host(pages).join(F.broadcast(learned) if size <= BROADCAST_BYTES else learned, "host", "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in pages.columns], "wrapper")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType(), False)])
    names = list(pages.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper | None] = {None: None}
        for b in batches:
            texts = []
            for html, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist()):
                if w not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[w] = Wrapper(json.loads(w))
                texts.append(extract(html, known[w]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return joined.mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLE: dict[str, str] = {}
