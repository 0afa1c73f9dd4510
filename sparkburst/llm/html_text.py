"""Main text of web pages by template deduction over the pages of a host.

A token is a tag in its place: an element with its classes, below the tokens of the elements
around it. Tokens whose occurrence vectors (how often on each page of the host) are equal
form an equivalence class. A vector is never gathered: per token, the xor over pages of a
hash of (page, count) stands for it, so a host with a third of all pages is summed by all
tasks. A class is valid if each of its tokens stands in a token of the class itself or of a
valid class around it; the valid classes so nest into the template, whose root class, the
skeleton, occurs once on every page. Text belongs to the slot of the innermost template
token around it. The skeleton's token that encloses the host's running text is the main
slot. Slots inside it are left out where the template shows a menu (mostly links) or where
an element that is named like an advert, notice or the like says the same on every page.
Names alone decide only for adverts and reader comments, and on hosts with one page; they
never mark what encloses the main slot or half of its text.

Constant text alone makes no slot part of a template: pages of a host can be copies of each
other and share whole passages, which belong to their articles.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Host templates that are broadcast at most (a few kB each); beyond it the join shuffles.
BROADCAST_HOSTS = 20_000
INLINE = frozenset("math mfrac mi mn mo mroot mrow ms msqrt msub msubsup msup mtext a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
SKIPPED = frozenset("head script style noscript template iframe textarea select button form nav footer aside dialog svg object canvas audio video title option datalist menu".split())
#: Closed by the start of any block, as the standard has it for paragraphs; and tags that close their own kind.
CLOSED_BY_BLOCK = frozenset(("p",))
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Names of elements that hold no running text: the first kind counts by itself, the second only with what the template shows.
OWN_NAMES = re.compile(r"(?:^|[-_.\s])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|cookies?|newsletter|comments?|commentlist|disqus)(?:$|[-_.\s\d])", re.IGNORECASE)
SOME_NAMES = re.compile(r"(?:^|[-_.\s])(?:banner|menu|nav\w*|breadcrumbs?|sidebar|side|footer|header|masthead|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|signup|login|share|sharing|social|related|recommend\w*|reply|replies|respond|discussion|promo\w*|pagination|pager|toolbar|widget|skip|legal|copyright)(?:$|[-_.\s\d])", re.IGNORECASE)
#: An attribute as the standard reads it: a quote opens a value only behind ``=``; elsewhere it is a character like others.
_VALUE = r"""(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]++))"""
_ATTRIBUTE = re.compile(rf"(=?[^\s/>=]*+)(?:\s*+=\s*+{_VALUE}?+)?+")
_ATTRIBUTES = re.sub(r"\((?!\?)", "(?:", rf"(?:[\s/]++|{_ATTRIBUTE.pattern})*+")
#: Comments and the like, and tags; a tag or comment that isn't closed goes on to the page's end.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|</(?=[^A-Za-z])[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})(>|\Z)", re.DOTALL)
#: How an element is named: not at all, by SOME_NAMES, by OWN_NAMES; or left out by its tag or by being hidden.
PLAIN, SOME, OWN, OUT = range(4)


@dataclass(slots=True)
class Element:
    """An open element: its tag, its token (an inline element has that of the block around it), what it inherits, and where the nearest block stands that it is or is in."""

    tag: str
    token: int
    out: bool
    article: bool
    main: bool
    left: bool
    block: int


@dataclass(slots=True)
class Block:
    """Text between the edges of block elements, the token it stands in, and if that is left out, in an article, in the main slot or in a slot that is left out."""

    token: int
    text: str
    links: int
    out: bool
    article: bool
    main: bool
    left: bool


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """A tag with its classes and id, and how it is named."""
    if not attributes.strip():
        return tag, PLAIN
    named: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1]:
            named.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    words = " ".join(named.get(k, "") for k in ("class", "id", "role"))
    kinds = ".".join(sorted(re.sub(r"\d+", "0", words).lower().split())[:4])
    if "hidden" in named or named.get("aria-hidden") == "true":
        return f"{tag}.{kinds}.hidden", OUT
    return f"{tag}.{kinds}" if kinds else tag, OWN if OWN_NAMES.search(words) else SOME if SOME_NAMES.search(words) else PLAIN


class Page:
    """The blocks of a page in order, and of each token how often it occurs, its parent, label and naming.

    Each tag costs the same however deep it stands.
    """

    def __init__(self, page: str | None, main: int | None = None, left_out: frozenset[int] = frozenset()) -> None:
        self.blocks: list[Block] = []
        self.counts: Counter[int] = Counter()
        self.tokens: dict[int, tuple[int, str, int]] = {}
        self._main, self._left = main, left_out
        self._stack: list[Element] = [Element("", 0, False, False, False, False, 0)]
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        self._links = 0
        self._read(page or "")

    def _flush(self) -> None:
        if self._text:
            joined = " ".join(html.unescape("".join(self._text)).split())
            if joined:
                top = self._stack[-1]
                self.blocks.append(Block(top.token, joined, self._links, top.out, top.article, top.main, top.left))
            self._text, self._links = [], 0

    def _close(self, depth: int) -> None:
        if any(x.tag not in INLINE for x in self._stack[depth:]):
            self._flush()
        self._open.subtract(x.tag for x in self._stack[depth:])
        del self._stack[depth:]

    def _push(self, tag: str, attributes: str) -> None:
        above = self._stack[-1]
        self._open[tag] += 1
        if tag in INLINE:
            self._stack.append(Element(tag, above.token, above.out, above.article, above.main, above.left, above.block))
            return
        label, named = _label(tag, attributes)
        if tag in SKIPPED or (tag == "header" and not above.article):
            named = OUT
        token = xxhash.xxh3_64_intdigest(f"{label}/{named}", seed=above.token)
        self.counts[token] += 1
        self.tokens.setdefault(token, (above.token, label, named))
        out = above.out or named == OUT
        self._stack.append(Element(tag, token, out, above.article or (tag in ("article", "main") and not out), above.main or token == self._main, above.left or token in self._left, len(self._stack)))

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            piece = page[at : m.start() if m else len(page)]
            if piece:
                self._text.append(piece)
                if self._open["a"] > 0:
                    self._links += len(piece.strip())
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag or not m[4]:  # a comment or the like, or a tag that the page's end cuts off
                continue
            if m[1]:
                if self._open[tag] > 0:
                    self._close(next(d for d in range(len(self._stack) - 1, 0, -1) if self._stack[d].tag == tag))
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._text.append(" ")
                continue
            if tag not in INLINE:
                self._flush()
                depth = self._stack[-1].block
                own = self._stack[depth].tag
                if depth and (own in CLOSED_BY_BLOCK or own in SAME_KIND.get(tag, ())):
                    self._close(depth)
            if m[3].rstrip().endswith("/") and tag in RAW:
                continue
            self._push(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                self._open[tag] -= 1
                self._stack.pop()
        self._flush()


def host_column() -> Column:
    """The host of a page's url in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_TOKENS = "host string, token long, parent long, label string, named int, vector long, pages long, least long, most long, chars long, links long, first long, last long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def token_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token: the xor that stands for its occurrence vector, on how many pages it is, its least and greatest count there, and its text: size, links, and the least and greatest hash of a page's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parsed = Page(page)
                texts: dict[int, list[str]] = {}
                links: Counter[int] = Counter()
                for b in parsed.blocks:
                    texts.setdefault(b.token, []).append(b.text)
                    links[b.token] += min(b.links, len(b.text))
                for token, n in (parsed.counts | {t: parsed.counts[t] for t in texts}).items():
                    mark = (key ^ (n * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
                    mark ^= mark >> 32
                    own = texts.get(token, [])
                    said = _signed(xxhash.xxh3_64_intdigest("\n".join(own)))
                    held = sums.setdefault((host, token), [*parsed.tokens.get(token, (0, "", PLAIN)), 0, 0, 1 << 40, 0, 0, 0, said, said])
                    held[3] ^= mark
                    held[4] += 1
                    held[5], held[6] = min(held[5], n), max(held[6], n)
                    held[7] += sum(map(len, own))
                    held[8] += links[token]
                    held[9], held[10] = min(held[9], said), max(held[10], said)
            rows = [(host, _signed(token), _signed(v[0]), v[1], v[2], _signed(v[3]), *v[4:]) for (host, token), v in sums.items()]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
            fields = [x.split() for x in _TOKENS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

    keyed = pages.select(F.xxhash64("page_id", "url", F.monotonically_increasing_id()).alias("_key"), host_column().alias("host"), "html")
    parts = keyed.mapInArrow(run, _TOKENS)
    return parts.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.min("label").alias("label"), F.min("named").alias("named"), F.expr("bit_xor(vector)").alias("vector"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("first").alias("first"), F.max("last").alias("last"))


def nested_classes(tokens: dict[int, dict]) -> list[list[int]]:
    """The valid equivalence classes, outer ones first; the first is the skeleton.

    A class is the tokens of one occurrence vector. It is valid if each of its tokens stands
    at the top of the page, in a token of its own class, or in one of a class found valid.
    """
    classes: dict[tuple, list[int]] = {}
    for t, x in tokens.items():
        if x["least"]:  # text outside of all elements is no token
            classes.setdefault((x["vector"], x["pages"], x["least"], x["most"]), []).append(t)
    waiting = sorted(classes.values(), key=lambda c: (-tokens[c[0]]["pages"], tokens[c[0]]["most"], min(tokens[t]["depth"] for t in c), min(c)))
    held, out, before = {0}, [], -1
    while len(waiting) != before:  # a pass for each level that classes nest in
        before, left = len(waiting), []
        for c in waiting:
            own = set(c)
            if all(tokens[t]["parent"] in held or tokens[t]["parent"] in own for t in c):
                out.append(c)
                held |= own
            else:
                left.append(c)
        waiting = left
    return out


def deduce_template(rows: list[dict]) -> dict:
    """The main slot of a host and the slots to leave out, from its tokens' statistics.

    Main slot: an article or main element of the skeleton, the one with most text; else its
    deepest token that encloses 70 % of the text outside of elements that are left out.
    """
    tokens = {0: {"token": 0, "parent": None, "depth": 0, "least": 0, "named": PLAIN, "chars": 0, "links": 0, "label": "", "pages": 0}}
    tokens |= {r["token"]: dict(r) for r in rows if r["least"]}
    lost = {t for t, x in tokens.items() if t and x["parent"] not in tokens}  # rare parents: no part of the template
    children: dict[int, list[int]] = {}
    for t, x in tokens.items():
        if t and t not in lost:
            children.setdefault(x["parent"], []).append(t)
    order, heap = [], [0]
    while heap:  # outer tokens first
        t = heap.pop()
        order.append(t)
        for child in children.get(t, ()):
            tokens[child]["depth"] = tokens[t]["depth"] + 1
            heap.append(child)
    tokens = {t: tokens[t] for t in order}
    for r in rows:  # text outside of all elements
        if not r["least"]:
            tokens[0] |= {"chars": r["chars"], "links": r["links"], "first": r["first"], "last": r["last"], "pages": r["pages"]}
    for t in order:
        x = tokens[t]
        x["out"] = x["named"] == OUT or (t != 0 and tokens[x["parent"]]["out"])
        x["good"], x["all"], x["linked"] = (0 if x["out"] else x["chars"] - x["links"]), x["chars"], x["links"]
        x["same"] = not x["chars"] or (x["pages"] > 1 and x["first"] == x["last"])
        x["title"] = x["label"].partition(".")[0] == "h1"
    for t in reversed(order[1:]):  # sums over what an element encloses
        x, above = tokens[t], tokens[tokens[t]["parent"]]
        for k in ("good", "all", "linked"):
            above[k] += x[k]
        above["same"] &= x["same"]
        above["title"] |= x["title"]

    classes = nested_classes({t: x for t, x in tokens.items() if t})
    template = {t for c in classes for t in c}
    skeleton = [t for t in (classes[0] if classes else []) if tokens[t]["most"] == 1 and not tokens[t]["out"]]
    whole = max((tokens[t]["good"] for t in skeleton), default=0)
    named = [t for t in skeleton if tokens[t]["label"].partition(".")[0] in ("article", "main") and tokens[t]["good"] * 2 >= whole]
    near = [t for t in skeleton if tokens[t]["good"] * 10 >= whole * 7]
    main = max(named, key=lambda t: (tokens[t]["good"], tokens[t]["depth"])) if named else max(near, key=lambda t: (tokens[t]["depth"], tokens[t]["good"]), default=None)

    inside: set[int] = set()
    left_out = []
    for t in order[1:]:
        x = tokens[t]
        if (t != main and x["parent"] not in inside and main is not None and x["parent"] != main) or t == main:
            continue
        inside.add(t)
        size = tokens[main]["all"] if main is not None else tokens[0]["all"]
        menu = t in template and x["chars"] and x["links"] * 10 > x["chars"] * 7
        few = x["all"] * 2 < size
        shown = x["linked"] * 2 > x["all"] or (x["pages"] > 1 and x["same"])
        by_name = few and (x["named"] == OWN or (x["named"] == SOME and (shown or (x["pages"] == 1 and x["all"] * 5 < size and not x["title"]))))
        if menu or by_name:
            left_out.append(t)
    return {"main": main, "left_out": left_out}


def templates(pages: DataFrame) -> DataFrame:
    """One row per host: its main slot and the slots to leave out.

    Tokens that are on less than a hundredth of a host's pages are no part of its template,
    so a host has at most a hundred times the tokens of a page.
    """
    tokens = materialise(token_statistics(pages))
    most = tokens.groupBy("host").agg(F.max("pages").alias("_all"))
    kept = tokens.join(most, "host").where("pages * 100 >= _all")
    listed = kept.groupBy("host").agg(F.collect_list(F.struct(*[c for c in tokens.columns if c != "host"])).alias("tokens"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [deduce_template(list(t)) for t in f["tokens"]]
            yield pd.DataFrame({"host": f["host"], "main": pd.array([t["main"] for t in found], "Int64"), "left_out": [t["left_out"] for t in found]})

    return listed.mapInPandas(run, "host string, main long, left_out array<long>")


def extract(page: str | None, main: int | None, left_out: list[int]) -> str:
    """Blocks of the main slot, joined by newlines; of a page without it, those of its articles, or all that isn't left out."""
    unsigned = lambda x: x + (1 << 64) if x < 0 else x
    parsed = Page(page, None if main is None else unsigned(main), frozenset(map(unsigned, left_out)))
    blocks = [b for b in parsed.blocks if not (b.out or b.left)]
    if main is not None and unsigned(main) in parsed.counts:
        blocks = [b for b in blocks if b.main]
    elif any(b.article for b in blocks):
        blocks = [b for b in blocks if b.article]
    return "\n".join(b.text for b in blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if there is none) and n_chars.

    Null html is an empty page; pages without a host share one template; null and repeated
    ids and equal rows give a row each; pages of any length are read whole; further columns
    are ignored; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = materialise(templates(pages))
    known = F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known
    hosted = pages.withColumn("host", host_column())
    joined = hosted.join(known, "host", "left").select("page_id", "url", "html", "main", F.coalesce("left_out", F.array().cast("array<long>")).alias("left_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(*row) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; cases as in ``extract_pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
