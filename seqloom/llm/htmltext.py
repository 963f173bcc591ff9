"""Main text of web pages, by wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over tokens: tags, fixed texts, text slots, optional parts and
repeated parts.  A page alone is a wrapper whose texts are fixed.  Neighbouring stretches with the same tags
fold into a repeated part.  Pages of one shape, which differ in texts only, are one wrapper at once: a text that
changes becomes a slot.  Wrappers of different shapes are aligned; tokens that one side lacks become an optional
part, a repeated part takes in its single occurrences.  Alignment is applied again and again until a host
has one wrapper; every page counts, but only its host's shapes are aligned.

The wrapper's slots tell in which element the host's changing text lies, and a page's text is that of this element
without the parts that are menus, forms, adverts and the like.  Of elements that hold about as much changing text, an
<article> or <main> is taken.  A page that lacks the element, or whose host has no wrapper to learn (a single
page, no changing text), gives its <article> or <main>, or else what a class name or the body has.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.llm.common import query, small, stored, table
from seqloom.session import spread_rows

#: Wrappers of a host that are aligned in one group; rounds of groups go on until a host has one.
MERGED = 64
#: Nodes that two wrappers may have for an exact alignment; longer ones are split at equal runs first.
ALIGNED = 400
#: Up to so many bytes of wrappers are sent to all tasks; beyond that pages and wrappers are joined by host.
SENT = 32 << 20

# inside a tag, quotes that close within some thousand characters may hold anything; others are plain characters, and the
# tag ends at the next ">".  A plain "<" begins a new tag, so that no part of a page is looked at again and again.
INSIDE = r"(?:\"[^\"]{0,4096}+\"|'[^']{0,4096}+'|[^<>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|select|object|title)\b{INSIDE}>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>{INSIDE})>"
    r"|<[!?][^<>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are open inside each other, as far as they are told apart.
DEEPEST = 256
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: A new one of these ends an open one of the same group inside the same container.
CLOSES = {
    **{t: frozenset({"p"}) for t in BLOCKS - {"html", "head", "body", "option", "caption", "td", "th", "tr", "legend"}},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
CONTAINERS = frozenset("article aside body div footer form header html main nav ol section table ul dl td".split())
#: Elements that never hold main text; a header inside an article holds its headline.
ASIDE = frozenset("nav footer aside form button dialog menu head label fieldset input".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar "
    "sidenav menu navbar nav navigation breadcrumb breadcrumbs comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations footer masthead topbar toolbar pagination pager "
    "widget widgets skip tags hidden".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_WORDS = frozenset(
    "article articlebody post entry story content main maincontent postcontent entrycontent articletext".split()
)


class Element:
    """An open element: its tag and what its attributes call it."""

    __slots__ = ("tag", "sign", "aside", "main")

    def __init__(self, tag: str, rest: str):
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest else {}
        named = f"{found.get('class', '')} {found.get('id', '')}".strip()
        words = set(re.split(r"[^a-z]+", named.lower())) if named else set()
        role = found.get("role", "").lower()
        self.tag = tag
        self.sign = f"{tag}.{' '.join(sorted(found.get('class', '').split()))}" if "class" in found else tag
        self.main = (
            tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
        )
        hidden = found.get("aria-hidden", "").lower() == "true" or bool(rest and re.search(r"\shidden(\s|=|/|$)", rest))
        plain = tag in ("html", "body") or self.main
        self.aside = tag in ASIDE or role in ASIDE_ROLES or hidden or (not plain and bool(words & ASIDE_WORDS))
        if not self.main and not self.aside and words & MAIN_WORDS:
            self.main = None  # perhaps


@lru_cache(maxsize=1 << 12)
def element(tag: str, rest: str) -> Element:
    return Element(tag, rest)


def tokens(page: str) -> Iterator[tuple[str, object]]:
    """("text", raw), ("open", (tag, attributes)) and ("close", tag); comments, scripts and the like are left out."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m["name"]:
            tag = m["name"].lower()
            if m["end"]:
                yield "close", tag
            else:
                yield "open", (tag, m["rest"])
        elif m["raw"]:
            yield "open", ("hr", "")  # what stood there parts the texts beside it
    if at < len(page):
        yield "text", page[at:].partition("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", page[at:]) else page[at:]


def placed(page: str) -> Iterator[tuple[str, list[Element], object]]:
    """Tokens with the elements that are open around them; unclosed elements close as browsers close them.

    Elements that lie deeper than ``DEEPEST`` lie side by side there.
    """
    stack: list[Element] = []
    beyond: dict[str, int] = {}  # open elements that are not on the stack
    for kind, value in tokens(page):
        if kind == "text":
            yield kind, stack, value
        elif kind == "open":
            tag, rest = value
            ends = CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
                    if stack[i].tag in CONTAINERS:
                        break
            own = element(tag, rest)
            yield kind, stack, own
            if tag not in VOID and not rest.rstrip().endswith("/"):
                if len(stack) < DEEPEST:
                    stack.append(own)
                else:
                    beyond[tag] = beyond.get(tag, 0) + 1
        elif len(stack) == DEEPEST and beyond.get(value):
            beyond[value] -= 1
            yield kind, stack, value
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == value:
                    yield kind, stack, value
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and value not in ("html", "body"):
                    break


# ---- wrappers -----------------------------------------------------------------
# A wrapper is a list of nodes: ["<", sign], [">", tag], ["#", digest, length] a fixed text, ["#", null, length]
# a slot, ["?", nodes] an optional and ["+", nodes] a repeated part.


WIDTHS = 1, 2, 3, 4, 5, 6, 8, 12


def page_wrapper(page: str) -> list:
    """The page as a wrapper, its repeated parts folded."""
    nodes: list = []
    ids: list[int] = []  # the nodes' shapes, numbered
    numbers: dict = {}
    for kind, _, value in placed(page):
        if kind == "text":
            plain = " ".join(value.split())
            if not plain:
                continue
            nodes.append(["#", xxhash.xxh3_64_hexdigest(plain.encode("utf-8", "surrogatepass")), len(plain)])
            ids.append(numbers.setdefault("#", len(numbers)))
        else:
            node = ["<", value.sign] if kind == "open" else [">", value]
            nodes.append(node)
            ids.append(numbers.setdefault(tuple(node), len(numbers)))
        for width in WIDTHS:
            if len(ids) <= width:
                break
            _fold(nodes, ids, numbers, width)
    return nodes


def _shape(node: list):
    """What must agree for two nodes to be one: texts agree with any text."""
    if node[0] == "#":
        return "#"
    if node[0] in "?+":
        return node[0], tuple(map(_shape, node[1]))
    return node[0], node[1]


def _fold(nodes: list, ids: list[int], numbers: dict, width: int) -> None:
    """Fold the last ``width`` nodes into what stands before them, if it has the same shape."""
    first = nodes[-width][0]
    if first not in "<?+" or (width == 1 and first == "<"):
        return
    own = ids[-width:]
    repeat = numbers.get(("+", *own))
    again = repeat is not None and ids[-width - 1] == repeat
    if not again and (first == "+" or len(ids) < 2 * width or ids[-2 * width : -width] != own):
        return
    last = nodes[-width:]
    if sum((n[0] == "<" and n[1].partition(".")[0] not in VOID) - (n[0] == ">") for n in last) not in (0, 1):
        return
    before = nodes[-width - 1][1] if again else nodes[-2 * width : -width]
    gone = width + 1 if again else 2 * width
    del nodes[-gone:], ids[-gone:]
    nodes.append(["+", [_one_after_other(a, b) for a, b in zip(before, last)]])
    ids.append(numbers.setdefault(("+", *own), len(numbers)))


def _one_after_other(a: list, b: list) -> list:
    """A node of a repeated part for two of the same shape: what stands there one after the other is one fixed text of the page."""
    if a[0] == "#":
        return ["#", xxhash.xxh3_64_hexdigest(a[1] + b[1]), max(a[2], b[2])]
    if a[0] in "?+":
        return [a[0], [_one_after_other(x, y) for x, y in zip(a[1], b[1])]]
    return a


def _both(a: list, b: list) -> list:
    """One node for two of the same shape: texts that differ become a slot."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, max(a[2], b[2])]
    if a[0] in "?+":
        return [a[0], [_both(x, y) for x, y in zip(a[1], b[1])]]
    return a


def align(a: list, b: list) -> list:
    """The wrapper of all that either wrapper takes."""
    numbers: dict = {}
    x, y = ([numbers.setdefault(_shape(n), len(numbers)) for n in nodes] for nodes in (a, b))
    head = 0
    while head < min(len(a), len(b)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = [_both(p, q) for p, q in zip(a[:head], b[:head])]
    out += _middle(a[head : len(a) - tail], b[head : len(b) - tail], x[head : len(a) - tail], y[head : len(b) - tail])
    return out + [_both(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :])]


def _middle(a: list, b: list, x: list, y: list) -> list:
    """Longest common subsequence of shapes; what one side lacks is optional, a lone occurrence joins its repeat."""
    if not a or not b:
        return _optional(a) + _optional(b)
    if len(a) * len(b) > ALIGNED * ALIGNED:
        i, j, n = _common_run(x, y)
        if not n:
            return _unmatched(a, b)
        out = _middle(a[:i], b[:j], x[:i], y[:j]) + [_both(p, q) for p, q in zip(a[i : i + n], b[j : j + n])]
        return out + _middle(a[i + n :], b[j + n :], x[i + n :], y[j + n :])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j, i0, j0 = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if x[i] == y[j]:
            out += _unmatched(a[i0:i], b[j0:j]) + [_both(a[i], b[j])]
            i, j = i + 1, j + 1
            i0, j0 = i, j
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out + _unmatched(a[i0:], b[j0:])


def _common_run(x: list, y: list) -> tuple[int, int, int]:
    """(place in x, place in y, length) of the longest run of shapes that both have, the one nearest the middle of equal ones."""
    one, other = np.array(x), np.array(y)
    runs, best = np.zeros(len(other) + 1, np.int64), (0, 0, 0, 0)
    for i, shape in enumerate(one):
        runs[1:] = np.where(other == shape, runs[:-1] + 1, 0)
        j = int(runs.argmax())
        n = int(runs[j])
        best = max(best, (n, -abs(2 * i - n - len(one)), i + 1 - n, j - n))
    return best[2], best[3], best[0]


def _unmatched(a: list, b: list) -> list:
    """An optional or repeated part of one side may stand plainly on the other; the rest is optional."""
    for one, other in ((a, b), (b, a)):
        for k, node in enumerate(one):
            if node[0] in "?+":
                shape, n = tuple(map(_shape, node[1])), len(node[1])
                for i in range(len(other) - n + 1):
                    if tuple(map(_shape, other[i : i + n])) == shape:
                        both = [node[0], [_both(p, q) for p, q in zip(node[1], other[i : i + n])]]
                        return _optional(one[:k] + other[:i]) + [both] + _optional(one[k + 1 :] + other[i + n :])
    return _optional(a) + _optional(b)


def _optional(nodes: list) -> list:
    """What may be missing: one part for each stretch that is not optional already; equal neighbours are one."""
    out: list = []
    run: list = []
    for node in [*nodes, None]:
        if node is not None and node[0] != "?":
            run.append(node)
            continue
        for part in ([["?", run]] if run else []) + ([node] if node else []):
            if out and _shape(out[-1]) == _shape(part):
                out[-1] = _both(out[-1], part)
            else:
                out.append(part)
        run = []
    return out


def region(wrapper: list) -> str | None:
    """Path of the element that holds most of the changing text outside of asides; null if none does.

    Of those that hold four fifths as much as any, the outermost that is an article by its tag, else the innermost.
    """
    held: dict[str, int] = {}
    articles: set[str] = set()
    path: list[tuple[str, bool]] = []

    def walk(nodes: list, times: int) -> None:
        for node in nodes:
            if node[0] == "<":
                tag = node[1].partition(".")[0]
                if tag not in VOID:
                    own = Element(tag, f' class="{node[1].partition(".")[2]}"')
                    path.append((node[1], own.aside or tag in ("a", "header")))
            elif node[0] == ">":
                for i in range(len(path) - 1, -1, -1):
                    if path[i][0].partition(".")[0] == node[1]:
                        del path[i:]
                        break
            elif node[0] == "#":
                if node[1] is None and not any(aside for _, aside in path):
                    for i in range(1, len(path) + 1):
                        if path[i - 1][0].partition(".")[0] in CONTAINERS:
                            name = "/".join(s for s, _ in path[:i])
                            if path[i - 1][0].partition(".")[0] in ("article", "main"):
                                articles.add(name)
                            held[name] = held.get(name, 0) + node[2] * times
            else:
                walk(node[1], times * (3 if node[0] == "+" else 1))

    walk(wrapper, 1)
    if not held:
        return None
    most = max(held.values())
    deep = lambda p: (p.count("/"), p)
    large = [p for p, n in held.items() if 5 * n >= 4 * most]
    named = [p for p in large if p in articles]
    return min(named, key=deep) if named else max(large, key=deep)


# ---- text ----------------------------------------------------------------------


def main_text(page: str, path: str | None = None) -> str:
    """The article's blocks, joined by two newlines.

    The article is the element at ``path``, which the host's wrapper has found; else the page's <article> or <main>; else
    one whose name says so; else the whole body.
    """
    blocks: dict[str, list[str]] = {"named": [], "path": [], "perhaps": [], "all": []}
    open_block: dict[str, list[str]] = {k: [] for k in blocks}

    def end(*kinds: str) -> None:
        for k in kinds or blocks:
            plain = " ".join("".join(open_block[k]).split())
            if plain:
                blocks[k].append(plain)
            open_block[k].clear()

    signs = path.split("/") if path else None
    # an element of an article that holds another article, such as a teaser, is not told apart from it
    for kind, stack, value in placed(page):
        if kind == "text":
            if any(e.aside for e in stack):
                continue
            named = any(e.main for e in stack)
            if not named and any(e.tag == "header" for e in stack):
                continue
            words = html.unescape(value)
            open_block["all"].append(words)
            if named:
                open_block["named"].append(words)
            if any(e.main is None for e in stack):
                open_block["perhaps"].append(words)
            if signs and [e.sign for e in stack[: len(signs)]] == signs:
                open_block["path"].append(words)
        else:
            tag = value.tag if kind == "open" else value
            if tag in BLOCKS:
                end()
            elif tag == "br":
                for k in blocks:
                    open_block[k].append(" ")
    end()
    for k in ("path", "named", "perhaps", "all"):
        if blocks[k]:
            return "\n\n".join(blocks[k])
    return ""


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _packed(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


WRAPPERS = "host string, shape string, wrapper string, pages long"


def infer_wrappers(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """(host, wrapper, pages): one wrapper per host, as JSON.

    Every page counts.  Pages of one host and shape become one wrapper in time proportional to their number, first in the task that
    reads them, then in parts, then whole.  The shapes of a host are aligned in groups of ``MERGED``, round after
    round, until one is left.  Pages without a host get none.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], list] = {}
        for batch in small(batches):
            for name, page in zip(batch.column("host").to_pylist(), batch.column(html_column).to_pylist()):
                own = page_wrapper(page)
                shape = xxhash.xxh3_128_hexdigest(repr([_shape(n) for n in own]).encode("utf-8", "surrogatepass"))
                known = found.get((name, shape))
                if known is None:
                    found[name, shape] = [own, 1]
                else:
                    known[0] = [_both(a, b) for a, b in zip(known[0], own)]
                    known[1] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in found], pa.string()), pa.array([k for _, k in found], pa.string()),
                pa.array([_packed(w) for w, _ in found.values()], pa.string()), pa.array([n for _, n in found.values()], pa.int64()),
            ],
            ["host", "shape", "wrapper", "pages"],
        )

    def merged(join):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            wrapper = None
            for one in map(json.loads, group.sort_values("_n").wrapper):
                wrapper = one if wrapper is None else join(wrapper, one)
            row = {"host": group.host.iloc[0], "shape": group["shape"].iloc[0], "wrapper": _packed(wrapper), "pages": int(group.pages.sum())}
            return pd.DataFrame([row])

        return run

    same = merged(lambda a, b: [_both(p, q) for p, q in zip(a, b)])
    rows = pages.select(host(F.col(url)).alias("host"), F.coalesce(F.col(html_column), F.lit("")).alias(html_column))
    rows = spread_rows(rows.filter((F.col("host") != "") & (F.col(html_column) != "")))
    part = rows.mapInArrow(learn, WRAPPERS).withColumn("_n", F.lit(0))
    for by in (F.spark_partition_id() % MERGED, F.lit(0)):  # any order of these gives the same wrapper
        part = part.withColumn("_turn", by).groupBy("host", "shape", "_turn").applyInPandas(same, WRAPPERS).withColumn("_n", F.lit(0))
    part = stored(part)
    order = W.partitionBy("host").orderBy(F.desc("pages"), "shape", "wrapper")
    while part.groupBy("host").count().filter("count > 1").head(1):
        part = part.withColumn("_n", F.row_number().over(order)).withColumn("_group", F.floor((F.col("_n") - 1) / MERGED))
        part = stored(part.groupBy("host", "_group").applyInPandas(merged(align), WRAPPERS))
    return part.select("host", "wrapper", "pages")


def regions(wrappers: DataFrame) -> DataFrame:
    """(host, region): where each host's changing text lies, learned from two pages or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [region(json.loads(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "region"])

    return wrappers.filter("pages > 1").select("host", "wrapper").mapInArrow(run, "host string, region string")


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html", sent: int = SENT
) -> DataFrame:
    """(key, url, text) for every row: the main text, empty if there is none.

    A null page is an empty page; a page whose address is null or has no host is read by itself.  Rows with
    equal keys are read one by one; other columns are not read.
    """
    where = stored(regions(infer_wrappers(pages, html_column, url)))
    size = where.agg(F.sum(F.octet_length("host") + F.octet_length("region"))).first()[0] or 0
    kind = pages.schema[key].dataType.simpleString()
    rows = spread_rows(
        pages.select(key, url, F.coalesce(F.col(html_column), F.lit("")).alias(html_column), host(F.col(url)).alias("_host"))
    )
    shared = None
    if size <= sent:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.region for r in where.collect()})  # checked
    else:
        where = where.withColumnsRenamed({"host": "_host", "region": "_region"})
        rows = rows.hint("merge").join(where, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            own = batch.column("_host").to_pylist()
            paths = map(shared.value.get, own) if shared else batch.column("_region").to_pylist()
            found = [main_text(p, path) for p, path in zip(batch.column(html_column).to_pylist(), paths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(found, pa.string())], [key, url, "text"]
            )

    return rows.mapInArrow(run, f"{key} {kind}, {url} string, text string")


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
