"""Main text of web pages by wrapper inference.

A page is a stream of blocks, each named by the path of its containers.  Texts that most
pages of a host repeat are fixed tokens, other texts are slots.  The distinct streams of a
host are aligned one after another into a union-free expression: repeated stretches become
groups, stretches that some pages lack become optional.  Every page is then read by its
host's expression: fixed tokens and repeated groups of links are template, and slots in the
region that holds most of the varying text are content.  Tags and class words decide only
what stands apart from an article by them, and blocks that the expression cannot place.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import prepare, rows, table

#: A text is a fixed token if so many pages of a host repeat it, and this share of them; if
#: fixed tokens hold more than FIXED of a host's text, its pages are copies and none is fixed.
REPEATS, SHARE, FIXED = 5, 0.6, 0.3
#: The region of the content holds this share of a host's varying text; a page without text
#: there is judged by tags.  Groups of this link share are menus.
REGION, MENU = 0.6, 0.6
#: Parts that a host's streams are dealt to before they meet.
PARTS = 8
#: Bytes of all wrappers together up to which they are broadcast.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture"}
_ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_APART = {"nav", "header", "footer", "aside", "form", "fieldset", "button", "select", "dialog", "menu", "head", "object", "embed", "audio", "video", "canvas"}
#: Words in class, id and role that mark a region which is not the article.
_WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments reply replies disqus respond related recommended recommendations login search searchform pagination pager toolbar copyright complementary contentinfo".split())
_MAIN = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story|content|main)(?:[-_ ]?(?:body|content|text|main))?(?:$|[-_ ])", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(maxsize=4096)
def _region(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Label of a container, whether it stands apart from the article, whether it is the article."""
    named, role = [], ""
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if name.lower() in ("class", "id"):
            named.append(value)
        elif name.lower() == "role":
            role = value.lower()
    words = {w.lower() for v in named for w in _PART.findall(v)} | {role}
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", attrs) is not None
    strong = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "promo", "sponsored", "related"}
    apart = tag in _APART or hidden or bool(words & (strong if tag in ("article", "main", "body", "html") else _WORDS))
    main = not apart and (tag in ("article", "main") or role in ("main", "article"))
    label = tag + ("." + re.sub(r"\d+", "N", named[0].split()[0]) if named and named[0].split() else "")
    return label, apart, main


def blocks(page: str) -> list[tuple[str, str, bool, bool, bool, float]]:
    """(path, text, apart, in article, in a container named like one, share of link text)
    of each block with text, in page order."""
    out: list[tuple] = []
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
    text: list[str] = []
    linked, in_link, skip, at = 0, False, None, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                _, path, apart, main, named = stack[-1]
                out.append((path, words, apart, main, named, linked / max(1, sum(map(len, text)))))
            text, linked = [], 0

    def close(to: int) -> None:
        nonlocal in_link
        flush()
        in_link = False
        del stack[to:]

    while at < len(page):
        if skip:
            end = re.compile(rf"</{skip}(?=[\s/>]|\Z)", re.I).search(page, at)
            skip, at = None, len(page) if end is None else end.start()
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            raw = m.group(0)
            if raw[0] != "<" or raw == "<":
                text.append(raw)
                if in_link:
                    linked += len(raw)
            continue
        if not m.group(4):
            break  # a tag cut off at the end of the page
        tag, closing = tag.lower(), bool(m.group(1))
        if tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
        elif tag in _INLINE:
            if tag == "a":
                in_link = not closing
        elif closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
        elif tag in _RAW:
            flush() if tag not in ("script", "style", "noscript", "template") else None
            if not m.group(3).endswith("/") or tag not in ("svg", "math"):
                skip = tag
        elif tag in _VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            in_link = False
            ends, bounds = _ENDS_ITSELF.get(tag, ()), _BOUNDS.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in bounds or not ends and stack[i][0] not in ("p",):
                    break
            if m.group(3).endswith("/"):
                continue
            label, apart, main = _region(tag, m.group(3).strip())
            _, path, was_apart, was_main, was_named = stack[-1]
            named = was_named or (not apart and "." in label and bool(_MAIN.search(label.partition(".")[2])))
            stack.append((tag, f"{path}/{label}", was_apart or apart, was_main or main, named))
    flush()
    return out


def _marks(node) -> tuple:
    """The core of a node (a symbol, or a group's nodes), whether it repeats and whether it is optional."""
    repeats = optional = False
    while isinstance(node, tuple) and len(node[1]) == 1:
        repeats, optional, node = repeats or node[0] == "+", optional or node[0] == "?", node[1][0]
    return (node, repeats, optional) if isinstance(node, str) else (node[1], True, optional)


def _node(core, repeats: bool, optional: bool):
    node = ("+", (core,) if isinstance(core, str) else core) if repeats else core
    return ("?", (node,)) if optional else node


def _fold(stream: list) -> list:
    """Adjacent repeats of a stretch of up to three nodes become one repeated group."""
    out = list(stream)
    for width in (1, 2, 3):
        folded, i = [], 0
        while i < len(out):
            unit, n = [_marks(x)[0] for x in out[i : i + width]], 1
            while len(unit) == width and [_marks(x)[0] for x in out[i + n * width : i + (n + 1) * width]] == unit:
                n += 1
            if n > 1:
                run = out[i : i + n * width]
                if width == 1:
                    folded.append(_node(unit[0], True, all(_marks(x)[2] for x in run)))
                else:
                    folded.append(_node(tuple(run[:width]), True, all(_marks(x)[2] for x in run)))
                i += n * width
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def infer_wrapper(streams: list[list]) -> list:
    """A union-free expression over block paths that reads all streams: symbols, ("+", group),
    ("?", group).  A group is read as any of its symbols, again and again."""
    wrapper: list | None = None
    for stream in streams:
        page = _fold(stream)
        if wrapper is None:
            wrapper = page
            continue
        left, right = [_marks(x) for x in wrapper], [_marks(x) for x in page]
        merged: list = []
        for kind, a, b, c, d in difflib.SequenceMatcher(None, [x[0] for x in left], [x[0] for x in right], autojunk=False).get_opcodes():
            if kind == "equal":
                merged += [_node(core, r1 or r2, o1 or o2) for (core, r1, o1), (_, r2, o2) in zip(left[a:b], right[c:d], strict=True)]
            else:
                merged += [_node(core, repeats, True) for core, repeats, _ in (*left[a:b], *right[c:d])]
        wrapper = _fold(merged)
    return wrapper or []


def _symbols(node) -> Iterator[str]:
    if isinstance(node, str):
        yield node
    else:
        for x in node[1] if isinstance(node, tuple) else node:
            yield from _symbols(x)


def _frozen(node):
    """A node as JSON gives it, with tuples for lists."""
    return node if isinstance(node, str) else (node[0], tuple(_frozen(x) for x in node[1]))


def items(expression: list) -> list[tuple[frozenset, bool, bool]]:
    """For each node of an expression its symbols, whether it repeats and whether it is optional."""
    return [(frozenset(_symbols(node)), *_marks(node)[1:]) for node in expression]


def parse(stream: list[str], nodes: list[tuple[frozenset, bool, bool]]) -> list[int]:
    """The node that reads each symbol: the one before if it repeats, else the next that has
    the symbol; -1 where none has."""
    where: dict[str, list[int]] = {}
    for i, (symbols, _, _) in enumerate(nodes):
        for x in symbols:
            where.setdefault(x, []).append(i)
    out, at = [], -1
    for x in stream:
        if at >= 0 and nodes[at][1] and x in nodes[at][0]:
            out.append(at)
            continue
        own = where.get(x, ())
        i = bisect.bisect_right(own, at)
        if i < len(own):
            at = own[i]
            out.append(at)
        else:
            out.append(-1)
    return out


def accepts(stream: list[str], nodes: list[tuple[frozenset, bool, bool]]) -> bool:
    """Whether the expression reads the whole stream and no node that it needs is left out."""
    read = parse(stream, nodes)
    return -1 not in read and not {i for i, n in enumerate(nodes) if not n[2]} - set(read)


class Inference:
    """A wrapper that grows by the streams it cannot read yet."""

    def __init__(self) -> None:
        self.expression: list = []
        self.nodes: list = []
        self.empty = True

    def add(self, stream: list) -> None:
        """``stream``: symbols, or an expression's nodes."""
        if self.empty or not (all(isinstance(x, str) for x in stream) and accepts(stream, self.nodes)):
            self.expression = infer_wrapper([_fold(stream)] if self.empty else [self.expression, stream])
            self.nodes, self.empty = items(self.expression), False


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _symbol(block: tuple) -> str:
    """Path of a block, and a (apart), m (in an article element), n (in one named like one)."""
    path, _, apart, main, named, _ = block
    return f"{path} {'a' * apart}{'m' * main}{'n' * named}"


def stream_of(got: list[tuple], fixed: set) -> list[str]:
    """Symbols of a page's blocks; those of fixed tokens end in the token's hash."""
    out = []
    for b in got:
        x = _symbol(b)
        token = _hash(b[1]) if fixed else 0
        out.append(f"{x}={token}" if (x, token) in fixed else x)
    return out


def _flags(symbol: str) -> str:
    return symbol.rpartition(" ")[2].partition("=")[0]


def decide(expression: list, slots: dict[str, tuple[int, int]]) -> dict:
    """Which nodes of a wrapper hold content.  ``slots``: symbol -> characters and linked
    characters on all pages of the host."""
    nodes = items(expression)
    linked = lambda xs: sum(slots.get(x, (0, 0))[1] for x in xs) / max(1, sum(slots.get(x, (0, 0))[0] for x in xs))
    fixed = [all("=" in x.rpartition(" ")[2] for x in xs) for xs, _, _ in nodes]
    menu = [(repeats or len(xs) > 1) and linked(xs) >= MENU for xs, repeats, _ in nodes]
    free = {x for (xs, _, _), f, m in zip(nodes, fixed, menu, strict=True) if not (f or m) for x in xs if "a" not in _flags(x) and x in slots}
    # where pages mark their article by an element, or at least by a name, the region lies in it
    for flag in "mn":
        free = {x for x in free if flag in _flags(x)} or free
    mass: dict[str, int] = {}
    for x in free:
        path = x.rpartition(" ")[0].rpartition("/")[0]
        while path:
            mass[path] = mass.get(path, 0) + slots[x][0]
            path = path.rpartition("/")[0]
    total = sum(slots[x][0] for x in free)
    wide = [path for path, n in mass.items() if total and n >= REGION * total]
    region = max(wide, key=lambda path: (path.count("/"), path), default=None)
    inside = lambda x: x in free and x.startswith(f"{region}/")
    keep = [region is not None and not f and not m and any(map(inside, xs)) for (xs, _, _), f, m in zip(nodes, fixed, menu, strict=True)]
    return {"nodes": [[sorted(xs), repeats, optional] for xs, repeats, optional in nodes], "keep": keep, "menu": menu, "content": sorted(filter(inside, free)), "region": region}


class Wrapper:
    """A host's wrapper as its pages are read by it; None stands for a host of one page."""

    def __init__(self, given: dict | None) -> None:
        self.known = bool(given) and given["region"] is not None
        self.fixed = {tuple(x) for x in given["fixed"]} if given else set()
        if self.known:
            self.nodes = [(frozenset(xs), repeats, optional) for xs, repeats, optional in given["nodes"]]
            self.keep, self.menu, self.content = given["keep"], given["menu"], set(given["content"])


def extract(page: str, wrapper: Wrapper) -> str:
    """The content blocks of a page, joined by line ends."""
    got = blocks(page)
    level = max((2 if b[3] else 1 if b[4] else 0 for b in got if not b[2]), default=0)
    alone = [not b[2] and (b[3] if level == 2 else b[4] if level == 1 else b[5] < 0.6) for b in got]
    if wrapper.known:
        stream = stream_of(got, wrapper.fixed)
        read = parse(stream, wrapper.nodes)
        placed = [node >= 0 and "a" not in _flags(x) for x, node in zip(stream, read, strict=True)]
        kept = [p and wrapper.keep[node] and x in wrapper.content for p, x, node in zip(placed, stream, read, strict=True)]
        if any(kept):
            alone = [k if p else own for k, p, own in zip(kept, placed, alone, strict=True)]
        else:  # a layout of few pages: only menus and fixed tokens are known of it
            alone = [own and not (p and (wrapper.menu[node] or "=" in x.rpartition(" ")[2])) for own, p, x, node in zip(alone, placed, stream, read, strict=True)]
    return "\n".join(b[1] for b, kept in zip(got, alone, strict=True) if kept)


def host_facts(pages: list[str]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(symbol, text hash) -> pages, characters, linked characters; ("", 0) counts the pages."""
    out: dict[tuple[str, int], tuple[int, int, int]] = {("", 0): (len(pages), 0, 0)}
    for page in pages:
        own: dict[tuple[str, int], tuple[int, int]] = {}
        for b in blocks(page):
            key = _symbol(b), _hash(b[1])
            n, linked = own.get(key, (0, 0))
            own[key] = n + len(b[1]), linked + round(len(b[1]) * min(1.0, b[5]))
        for key, (n, linked) in own.items():
            m, a, b_ = out.get(key, (0, 0, 0))
            out[key] = m + 1, a + n, b_ + linked
    return out


def host_wrapper(pages: list[str]) -> Wrapper:
    """The wrapper of a host whose pages fit into memory (``extract_text`` infers the same
    from tables)."""
    facts = host_facts(pages)
    n = len(pages)
    texts = {k: v for k, v in facts.items() if k[0]}
    plain = {k: v for k, v in texts.items() if "a" not in _flags(k[0])}
    fixed = {k: v[1] for k, v in plain.items() if v[0] >= REPEATS and v[0] >= SHARE * n}
    if sum(fixed.values()) > FIXED * sum(v[1] for v in plain.values()):
        fixed = {}
    slots: dict[str, tuple[int, int]] = {}
    for (x, _), (_, chars, linked) in texts.items():
        a, b = slots.get(x, (0, 0))
        slots[x] = a + chars, b + linked
    if n < 2:
        return Wrapper(None)
    grown = Inference()
    for stream in sorted({json.dumps(stream_of(blocks(p), set(fixed))) for p in pages}):
        grown.add(json.loads(stream))
    return Wrapper(decide(grown.expression, slots) | {"fixed": sorted(fixed)})


def _joined(pages: DataFrame, hosts: DataFrame, column: str) -> DataFrame:
    """Pages with what is known of their host (null where nothing is): broadcast if its size
    is checked, else a join that splits large hosts."""
    size = hosts.agg(F.coalesce(F.sum(F.length(column) + F.length("host")), F.lit(0))).first()[0]
    return pages.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url and text (empty if there is none).

    Null html counts as empty; pages without a host share one wrapper; a host's only page,
    blocks its wrapper cannot place, and pages without text in its region, are judged by
    tags, class words and link share; slots count however little text they hold;
    rows that repeat a page_id are read each; very long pages are read whole; equal streams
    count once and are aligned in their textual order, so ties do not matter; columns other
    than page_id, url and html are not read; an empty table gives no rows."""
    spark = pages.sparkSession
    prepare(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for own, page in rows(batch, "host", "html"):
                by.setdefault(own, []).append(page)
            out = [(own, *key, *value) for own, pages_ in by.items() for key, value in host_facts(pages_).items()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "symbol", "token", "pages", "chars", "linked"])

    counted = given.select("host", "html").mapInArrow(count, "host string, symbol string, token long, pages long, chars long, linked long")
    texts = table(counted.groupBy("host", "symbol", "token").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "texts")
    apart = F.substring_index("symbol", " ", -1).contains("a")
    totals = texts.groupBy("host").agg(F.sum(F.when(F.col("symbol") == "", F.col("pages"))).alias("n"), F.sum(F.when(~apart, F.col("chars"))).alias("plain")).where("n > 1")
    totals = table(totals, "hosts")
    repeated = texts.where((F.col("symbol") != "") & ~apart & (F.col("pages") >= REPEATS)).join(totals, "host").where(F.col("pages") >= SHARE * F.col("n"))
    # at most the blocks of a page over SHARE for each host
    fixed = repeated.groupBy("host").agg(F.sum("chars").alias("held"), F.first("plain").alias("plain"), F.collect_list(F.struct("symbol", "token")).alias("fixed")).where(F.col("held") <= FIXED * F.col("plain")).select("host", F.to_json(F.sort_array("fixed")).alias("fixed"))
    fixed = table(fixed, "fixed")
    # every symbol of a host, as in its expression
    slots = texts.where("symbol <> ''").groupBy("host", "symbol").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).join(totals.select("host"), "host")
    slots = slots.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("symbol", "chars", "linked")))).alias("slots"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str | None, set] = {}
        for batch in batches:
            out = set()
            for own, page, given_ in rows(batch, "host", "html", "fixed"):
                if given_ not in tokens:
                    if len(tokens) > 500:
                        tokens.clear()
                    tokens[given_] = {(x["symbol"], x["token"]) for x in json.loads(given_)} if given_ else set()
                out.add((own, json.dumps(stream_of(blocks(page), tokens[given_]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sorted(out)], pa.string()) for i in (0, 1)], names=["host", "stream"])

    streams = _joined(given.select("host", "html"), fixed, "fixed").mapInArrow(shape, "host string, stream string").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = streams.withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(PARTS))).repartition(parts, "host", "part").sortWithinPartitions("host", "part", "stream")

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One wrapper for each host and part; its streams come one after another."""
        key, grown = None, Inference()
        for batch in batches:
            done = []
            for own, part, stream in rows(batch, "host", "part", "stream"):
                if (own, part) != key:
                    if key is not None:
                        done.append((*key, json.dumps(grown.expression)))
                    key, grown = (own, part), Inference()
                grown.add(json.loads(stream))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["host", "part", "expression"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, json.dumps(grown.expression)), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "part", "expression"])

    partial = table(dealt.mapInArrow(infer, "host string, part long, expression string"), "partial")
    # at most PARTS rows for each host
    met = partial.join(totals.select("host"), "host").groupBy("host").agg(F.sort_array(F.collect_list("expression")).alias("expressions")).join(slots, "host").join(fixed, "host", "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for expressions, slots_, fixed_ in rows(batch, "expressions", "slots", "fixed"):
                grown = Inference()
                for x in expressions:
                    grown.add([_frozen(node) for node in json.loads(x)])
                found = decide(grown.expression, {x["symbol"]: (x["chars"], x["linked"]) for x in json.loads(slots_)})
                out.append(json.dumps(found | {"fixed": [(x["symbol"], x["token"]) for x in json.loads(fixed_ or "[]")]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    wrappers = table(met.select("host", "expressions", "slots", "fixed").mapInArrow(settle, "host string, wrapper string"), "wrappers")
    joined = _joined(given, wrappers, "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {}
        for batch in batches:
            out = []
            for page, wrapper in rows(batch, "html", "wrapper"):
                if wrapper not in known:
                    if len(known) > 500:
                        known.clear()
                    known[wrapper] = Wrapper(json.loads(wrapper) if wrapper else None)
                out.append(extract(page, known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(read, "page_id long, url string, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` with its main text and its number of code points."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
