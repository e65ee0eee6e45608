"""HTML extraction by wrapper inference: union-free regular expressions over the pages of a host.

A page is cut into tags and texts, and into a tree of block elements (what is inline within a block belongs to its text).
Each list of siblings becomes a union-free expression: in a list no label stands twice, as neighbours that repeat become a
repeated item, and a stretch in which labels come back becomes one repeated group of optional items. Two expressions are
aligned along their longest common labels: a text against a text is a slot, an item that one side lacks becomes optional,
labels that changed places become a repeated group. Items keep what the pages said about them, so aligning is associative.

Plan, in four moves:

1. Tasks parse pages to expressions. Equal ones of a host are one row with sums (a third of all pages may be one host's;
   they have few expressions), added up by Spark before and after the shuffle.
2. Expressions of a host are aligned in FAN groups by hash, the groups' wrappers then to the host's one.
3. Each distinct expression gets, from its host's wrapper, which of its slots are article: slots below an element that is
   furniture (by tag, role or name) are none; of the others those within article or main elements, or else those that are
   no lists of links and do not say the same on all of several pages.
4. Pages meet their expression's slots in a join (adaptive execution splits a frequent one) and are put together there.

Text: character references decoded, white space within a block turned into one space, blocks in page order joined by a line
feed. Line breaks (br) are white space, two in a row part blocks.

Defined cases: null html is empty; a null url has the host ''; a page without an article has the text ''; unclosed and
misnested tags are closed where a browser would; repeated rows are extracted alike; no pages give no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Groups in which a host's expressions are aligned first.
FAN = 256
#: A text that is the same on so many pages of a host is part of its frame; a slot of which more is links is a menu.
SAME_PAGES, LINKED = 3, 0.6
#: Labels of texts and of groups in expressions.
SLOT, GROUP = "#", "()"

# Element names of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title xmp iframe noembed noframes".split()
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label output meter progress area col link meta base param source track".split())
CLOSES_P = set("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul center".split())
# what a start tag closes, and where the search for it stops
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, set())}
# Elements, roles and names (words of class and id) of what is not the article, and of what is.
FURNITURE = set("head nav footer aside form script style noscript template button select textarea iframe object svg canvas audio video dialog menu title datalist noembed noframes xmp".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
FURNITURE_NAMES = set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead banner footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond replies reply "
    "discussion disqus pagination pager toolbar copyright skip search form".split()
)
ARTICLE_NAMES = set("article articlebody content main post entry story maincontent".split())
NOT_OWN = set("with has no without".split())

# a tag (quotes may hold >), a tag with an open quote, a comment or a declaration
TOKEN = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--(?:.*?--!?>|.*\Z)|<(?:[!?]|/[^a-zA-Z>])[^>]*>?|</>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Node:
    """A block element or, with the label SLOT, a text of a page."""

    __slots__ = ("children", "label", "linked", "text")

    def __init__(self, label: str) -> None:
        self.label, self.children, self.text, self.linked = label, [], [], 0


@lru_cache(1 << 14)
def label_of(tag: str, attributes: str) -> str:
    """The element's name, then ``-`` for furniture or ``+`` for an article, as its role and the words of class and id say, and
    the first name in its class or id without digits."""
    if not attributes.strip():
        return tag + ("-" if tag in FURNITURE else "+" if tag in ("article", "main") else "")
    found = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), entities.unescape(v.strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    kind = "-" if tag in FURNITURE or "hidden" in found or found.get("role", "").lower() in FURNITURE_ROLES else "+" if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or "articleBody" in found.get("itemprop", "") else ""
    told = set()
    for name in names:
        words = [w.lower() for w in WORD.findall(name)]
        if not (words and words[0] in NOT_OWN):
            told.update(words)
    if kind != "-" and tag not in ("html", "body") and told & FURNITURE_NAMES and not (tag == "main" or (told & ARTICLE_NAMES and not told & {"comment", "comments", "related", "recommended"})):
        kind = "-"
    elif not kind and told & {"articlebody", "maincontent"}:
        kind = "+"
    first = re.sub(r"\d+", "", names[0])[:40] if names else ""
    return tag + kind + (f".{re.sub(r'[^A-Za-z_-]', '_', first)}" if first else "")


def tag_of(label: str) -> str:
    return re.match(r"[^-+.]*", label)[0]


def kind_of(label: str) -> str:
    m = re.match(r"[^-+.]*([-+]?)", label)
    return m[1]


def parse(page: str) -> Node:
    """The tree of block elements of a page; texts are its leaves."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]  # open elements, inline ones too: those have their block's node
    breaks, linked = 0, 0
    at, size = 0, len(page)

    def say(raw: str) -> None:
        nonlocal breaks
        text = entities.unescape(raw) if "&" in raw else raw
        top = stack[-1][1]
        if text.strip():
            if not top.children or top.children[-1].label != SLOT or breaks > 1:
                top.children.append(Node(SLOT))
            breaks = 0
            if linked:
                top.children[-1].linked += len(text)
            top.children[-1].text.append(text)
        elif top.children and top.children[-1].label == SLOT:
            top.children[-1].text.append(" ")

    def close(k: int) -> None:
        nonlocal linked
        for name, _ in stack[k:]:
            linked -= name == "a"
        del stack[k:]

    search = TOKEN.search
    while at < size:
        m = search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"</?[a-zA-Z]", rest)  # a tag that never ends is none
            say(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        ends, tag, attributes, *other = m.groups()
        if tag is None:
            ends, tag, attributes = other
            if tag is None:
                continue
        tag = tag.lower()
        block = tag not in INLINE
        if ends:
            if tag == "br":
                breaks += 1
                say(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name == tag or (tag[0] == "h" and tag[1:].isdigit() and name[0] == "h" and name[1:].isdigit()):
                    close(k)
                    break
                if not block and name not in INLINE:
                    break
                if tag in ("p", "li") and name in ("article", "body", "td", "th", "section", "nav", "footer", "aside", "main"):
                    break
            breaks = 0 if block else breaks
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES:
            these, stops = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in these:
                    close(k)
                    break
                if stack[k][0] in stops:
                    break
        if tag == "br":
            breaks += 1
            say(" ")
            continue
        if tag in VOID:
            continue
        if not block:
            linked += tag == "a"
            stack.append((tag, stack[-1][1]))
            continue
        breaks = 0
        node = Node(label_of(tag, attributes))
        stack[-1][1].children.append(node)
        if tag in END:
            m = END[tag].search(page, at)
            if tag not in ("script", "style") and page[at : m.start() if m else size].strip():
                node.children.append(Node(SLOT))
                node.children[0].text.append(page[at : m.start() if m else size])
            at = page.find(">", m.start()) + 1 if m else size
            at = at or size
            continue
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path", "math"):
            stack.append((tag, node))
    return root


# An expression's item is [label, repeated, optional, children]; a list of items is a sequence without equal labels.


def folded(items: list[list]) -> list[list]:
    """A sequence without equal labels: equal neighbours become one repeated item, a stretch in which labels come back a
    repeated group of optional ones."""
    out: list[list] = []
    for x in items:
        if out and out[-1][0] == x[0] != GROUP:
            out[-1] = [x[0], True, out[-1][2] and x[2], aligned(out[-1][3], x[3])]
        else:
            out.append(x)
    last: dict[str, int] = {}
    count = 0
    for k, x in enumerate(out):
        for label in held(x):
            last[label] = k
            count += 1
    if len(last) == count:
        return out
    result, k = [], 0
    while k < len(out):
        end, j = k, k
        while j <= end:
            end = max(end, *(last[label] for label in held(out[j])))
            j += 1
        result.append(out[k] if end == k else grouped(out[k : end + 1]))
        k = end + 1
    return result


def held(item: list) -> list[str]:
    return [x[0] for x in item[3]] if item[0] == GROUP else [item[0]]


def grouped(items: list[list]) -> list:
    """One repeated group of all items, each once."""
    found: dict[str, list] = {}
    for x in items:
        for y in x[3] if x[0] == GROUP else [x]:
            own = found.get(y[0])
            found[y[0]] = [y[0], y[1] or own[1], True, aligned(own[3], y[3])] if own else [y[0], y[1], True, y[3]]
    return [GROUP, True, all(x[2] for x in items), [found[k] for k in sorted(found)]]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The expression that takes what either takes."""
    if a == b:
        return a
    where: dict[str, int] = {}
    for k, x in enumerate(b):
        for label in held(x):
            where[label] = k
    pairs = [(i, where[label]) for i, x in enumerate(a) for label in held(x) if label in where]
    # the longest chain of pairs that rises on both sides
    best, tails, chain = [], [], []
    for i, j in pairs:
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        best[k : k + 1] = [len(chain)]
        chain.append((i, j, best[k - 1] if k else -1))
    path = []
    k = best[-1] if best else -1
    while k >= 0:
        i, j, k = chain[k]
        path.append((i, j))
    out: list[list] = []
    at_a = at_b = 0
    for i, j in [*reversed(path), (len(a), len(b))]:
        if i < at_a or j < at_b:
            continue
        out += [[x[0], x[1], True, x[3]] for x in a[at_a:i]] + [[x[0], x[1], True, x[3]] for x in b[at_b:j]]
        if i < len(a):
            x, y = a[i], b[j]
            if GROUP in (x[0], y[0]):
                out.append(grouped([x, y])[:2] + [x[2] and y[2], grouped([x, y])[3]])
            else:
                out.append([x[0], x[1] or y[1], x[2] or y[2], aligned(x[3], y[3])])
        at_a, at_b = i + 1, j + 1
    return folded(out)


def expression(node: Node) -> list[list]:
    """The expression of a node's children; an element without children has an empty one."""
    children = node.children
    if not children:
        return []
    if len(children) == 1 and children[0].label == SLOT:
        return [[SLOT, False, False, []]]
    return folded([[c.label, False, False, [] if c.label == SLOT else expression(c)] for c in children])


def slots(items: list[list], path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """Paths of labels of the slots of an expression, in its order; a group is no step of a path."""
    for x in items:
        if x[0] == SLOT:
            yield path
        elif x[0] == GROUP:
            yield from slots(x[3], path)
        else:
            yield from slots(x[3], (*path, x[0]))


def leaves(node: Node, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Node]]:
    for c in node.children:
        if c.label == SLOT:
            yield path, c
        else:
            yield from leaves(c, (*path, c.label))


def pattern(items: list[list]) -> str:
    """The expression as a regular expression over a page's tokens: ``<label>``, ``</label>`` and ``#``."""
    out = ""
    for label, repeated, optional, children in items:
        body = SLOT if label == SLOT else pattern(children) if label == GROUP else f"{re.escape(f'<{label}>')}{pattern(children)}{re.escape(f'</{label}>')}"
        out += f"(?:{body}){'*' if repeated and optional else '+' if repeated else '?' if optional else ''}"
    return out


def tokens(node: Node) -> str:
    return "".join(SLOT if c.label == SLOT else f"<{c.label}>{tokens(c)}</{c.label}>" for c in node.children)


def clean(node: Node) -> str:
    return " ".join("".join(node.text).split())


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def written_out(items: list[list]) -> str:
    return json.dumps(items, separators=(",", ":"))


def parsed(pages: DataFrame, with_blocks: bool) -> DataFrame:
    """With blocks: the pages' rows (page_id, url, html) as page_id, url, host, form (a hash of the expression) and the blocks
    as (slot, text). Without: a row for each slot: host, form, expression, slot, and pages, chars, linked and the least and
    greatest hash of what it says."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "html"):
            out: dict[str, list] = {k: [] for k in (("form", "blocks") if with_blocks else ("host", "form", "expression", "slot", "chars", "linked", "said"))}
            hosts = b.column("host").to_pylist()
            for k, page in enumerate(b.column("html").to_pylist()):
                root = parse(page or "")
                items = expression(root)
                form = written_out(items)
                key = xxhash.xxh3_64_intdigest(form.encode()) - (1 << 63)
                number = {path: i for i, path in enumerate(slots(items))}
                if with_blocks:
                    out["form"].append(key)
                    out["blocks"].append([{"slot": number[path], "text": text} for path, leaf in leaves(root) if (text := clean(leaf))])
                    continue
                sums = [[0, 0, 0] for _ in number]
                for path, leaf in leaves(root):
                    s, text = sums[number[path]], "".join(leaf.text)
                    s[0] += len(text)
                    s[1] += leaf.linked
                    s[2] = xxhash.xxh3_64_intdigest(text.encode(), s[2])
                for i, s in enumerate(sums or [[0, 0, 0]]):
                    for name, v in zip(out, (hosts[k], key, form, i if sums else None, s[0], s[1], s[2] - (1 << 63)), strict=True):
                        out[name].append(v)
            if with_blocks:
                kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "host")), pa.array(out["form"], pa.int64()), pa.array(out["blocks"], kind)], ["page_id", "url", "host", "form", "blocks"])
            else:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    if with_blocks:
        page_id = pages.schema["page_id"].dataType.simpleString()
        return pages.mapInArrow(read, f"page_id {page_id}, url string, host string, form long, blocks array<struct<slot: int, text: string>>")
    return pages.select("host", "html").mapInArrow(read, "host string, form long, expression string, slot int, chars long, linked long, said long")


def forms(pages: DataFrame) -> DataFrame:
    """host, form, expression, pages, stats (chars, linked, first and last hash by slot) of the distinct expressions."""
    n = parsed(pages, with_blocks=False).groupBy("host", "form", "expression", "slot").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("said").alias("low"), F.max("said").alias("high"))
    return n.groupBy("host", "form", "expression").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "chars", "linked", "low", "high")))).alias("stats"))


class Wrapper:
    """A host's expression with what its slots say: path -> [pages, chars, linked, low, high]."""

    def __init__(self, items: list[list], stats: dict[tuple[str, ...], list[int]]) -> None:
        self.items, self.stats = items, stats

    def take(self, items: list[list], stats: Iterable[tuple[tuple[str, ...], list[int]]]) -> None:
        self.items = aligned(self.items, items)
        for path, s in stats:
            own = self.stats.setdefault(path, [0, 0, 0, s[3], s[4]])
            for k in range(3):
                own[k] += s[k]
            own[3], own[4] = min(own[3], s[3]), max(own[4], s[4])


def wrappers(found: DataFrame) -> DataFrame:
    """host, wrapper (JSON: an expression and its slots' sums) from a table of forms."""

    def join(group: pa.Table) -> pa.Table:
        w = None
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("expression", "pages", "stats", "wrapper")), strict=True), key=lambda r: (-(r[1] or 0), r[0] or r[3]))
        for form, n, stats, made in rows:
            if made is not None:
                items, listed = json.loads(made)
                listed = [(tuple(p), s) for p, s in listed]
            else:
                items = json.loads(form)
                listed = [(path, [n, s["chars"], s["linked"], s["low"], s["high"]]) for path, s in zip(slots(items), stats, strict=True)]
            w = w or Wrapper(items, {})
            w.take(items, listed)
        made = json.dumps([w.items, [[list(p), s] for p, s in sorted(w.stats.items())]], separators=(",", ":"))
        return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([made], pa.string())})

    stats = found.schema["stats"].dataType.simpleString()
    first = found.select("host", "expression", "pages", "stats", F.lit(None).cast("string").alias("wrapper"), F.pmod(F.xxhash64("form"), F.lit(FAN)).alias("fan"))
    parts = first.groupBy("host", "fan").applyInArrow(join, "host string, wrapper string")
    again = parts.select("host", F.lit(None).cast("string").alias("expression"), F.lit(None).cast("long").alias("pages"), F.lit(None).cast(stats).alias("stats"), "wrapper")
    return again.groupBy("host").applyInArrow(join, "host string, wrapper string")


def is_furniture(path: tuple[str, ...], holders: set[tuple[str, ...]]) -> bool:
    """Whether an element on the path is furniture. A header is, but for an article's own; nothing is that holds an article."""
    for k, label in enumerate(path):
        kind, tag = kind_of(label), tag_of(label)
        inside = any(kind_of(x) == "+" for x in path[:k])
        if (kind == "-" or (tag == "header" and not inside)) and path[: k + 1] not in holders:
            return True
    return False


def article_slots(items: list[list], stats: dict[tuple[str, ...], list[int]]) -> list[int]:
    """Which slots of an expression are article, by its host's wrapper."""
    paths = list(slots(items))
    holders = {p[: k + 1] for p in paths for j, label in enumerate(p) if kind_of(label) == "+" for k in range(j) if not any(tag_of(x) in FURNITURE for x in p[: j + 1])}
    good = [k for k, p in enumerate(paths) if not is_furniture(p, holders)]
    inside = [k for k in good if any(kind_of(x) == "+" for x in paths[k])]
    if any(stats[paths[k]][1] for k in inside):
        return inside
    if inside:
        good = [k for k in good if k not in inside]
    several = [k for k in good if stats[paths[k]][0] >= SAME_PAGES]
    varies = any(stats[paths[k]][3] != stats[paths[k]][4] for k in several)

    def kept(k: int) -> bool:
        n, chars, linked, low, high = stats[paths[k]]
        return linked <= LINKED * chars and not (varies and n >= SAME_PAGES and low == high)

    return [k for k in good if kept(k)]


def slots_of(found: DataFrame, made: DataFrame) -> DataFrame:
    """host, form, keep (slots) of each distinct expression."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in batches:
            keep = []
            for form, wrapper in zip(b.column("expression").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if wrapper != last:
                    last, known = wrapper, {tuple(p): s for p, s in json.loads(wrapper)[1]}
                keep.append(article_slots(json.loads(form), known))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("form"), pa.array(keep, pa.list_(pa.int32()))], ["host", "form", "keep"])

    return found.select("host", "form", "expression").join(made, "host").mapInArrow(choose, "host string, form long, keep array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``pages`` needs page_id, url and html; other columns are ignored.
    """
    spark = pages.sparkSession
    common.configure(spark)
    cut = common.Cuts(spark)
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = cut(forms(own), "forms")
    keep = cut(slots_of(found, wrappers(found)), "slots")
    read = parsed(own, with_blocks=True).join(keep, ["host", "form"])
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("keep", b["slot"])), lambda b: b["text"]), "\n")
    return read.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
