"""Main text of pages by deducing each host's template.

Pass 1 turns a page into tokens: elements, told apart by their path of tags, classes and
ids, and the text of blocks, told apart by the path they stand in. (A block is the least
that is ever dropped, so its words are one token.) For each host and token it gathers
the occurrence vector over the host's pages: how often the token stands in each page.
Vectors are held as sums of hashes of (page, count), which map-side aggregation can add
up; equal vectors have equal sums. Tokens of one host with equal vectors form a class.
A class is valid if it stands in enough pages and holds both elements and text: such
elements nest the text, and the class is a part of the template. Classes of all pages
are the outermost part, those of fewer pages are optional parts within.

Elements that stand once in each of a class's pages are the template's frame. For each of
them the pages' text that is neither a link nor of the template adds up; one that holds
``MOST`` of all such text of its pages frames the slots of the article, and the innermost
such element of a page is its region.

Pass 2 takes the template's text away and keeps the slots of the region. Within it go
those that stand in menus, sidebars, notices, adverts, forms, comments and the like by
their tags or names; names outside the region say nothing. A marked article
that holds most of the region's text sets the bounds instead, since a region may leave out
a title or an opening. In pages without a region or a marked article everything stays that
is neither of the template nor beside by its tags and names, but for menus: text that is
mostly links in a list, or in an element without other text.

Cases: null or empty html gives an empty text. A null URL, or one without ``://``,
belongs to the host ''. Hosts with fewer than ``LEAST_PAGES`` pages have no template,
so names and tags alone decide; pages of a host with equal html count once. If the
template would take ``MOST`` of a host's text, its pages are near copies of each other and
no text is taken away; nor is it if it is all that a page's article has. Unclosed
and stray tags are tolerated. Repeated rows stay. Extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import BROADCAST_BYTES, carried, restored, salted_join, sized_join
from vellumine.llm.url_filter import host_of
from vellumine.shared import cut

#: Pages that a template class must stand in: so many, and this share of the host's.
LEAST_PAGES, LEAST_SHARE = 3, 0.1
#: Share of a host's varying text that an element must hold to frame its articles.
MOST = 0.7
#: Tokens that a task holds before it sends them on.
HELD = 400_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|(?![\"'])[^\s>]*))*+)(?:>|\Z)|<[/!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names of the HTML standard by what they do here.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
LISTED = frozenset("li dt dd td th".split())
HOLDERS = frozenset("article body center div main section td".split())
#: Elements that a new one of the same group closes, up to the element that holds the group.
CLOSES = {
    **dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6"), ({"p"}, frozenset("div article section main td li body blockquote button".split()))),
    "li": ({"li"}, frozenset(("ul", "ol", "menu"))),
    "dt": ({"dt", "dd"}, frozenset(("dl",))),
    "dd": ({"dt", "dd"}, frozenset(("dl",))),
    "tr": ({"tr", "td", "th"}, frozenset(("table",))),
    "td": ({"td", "th"}, frozenset(("tr", "table"))),
    "th": ({"td", "th"}, frozenset(("tr", "table"))),
    "option": ({"option"}, frozenset(("select",))),
}
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form header hr main menu nav ol pre section table ul".split())
DROPPED = frozenset("head nav footer aside form dialog menu select button svg math canvas object audio video datalist".split())
# Words in class, id and role that name parts beside the article.
BESIDE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar complementary contentinfo widget widgets comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar skip copyright legal disclaimer search searchbox dialog form paywall outbrain taboola discussion discussions responses feedback talkback rail aside secondary colophon adsense adunit adcontainer promoted topnav subnav megamenu dropdown toc".split()
)
#: Words that say a name is about the layout around: ``has-sidebar`` is no sidebar.
AROUND = frozenset("has with no without layout".split())
HEADING = frozenset("header masthead topbar".split())
ARTICLE = frozenset("article articlebody post entry story content main".split())


class _Names:
    """What the attributes of a start tag say; remembered by their text."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, str], tuple[str, int]] = {}

    def of(self, tag: str, attributes: str) -> tuple[str, int]:
        """(class and id, 1 beside the article, 2 heading, 4 marked article, 8 marked by name only, 16 form)"""
        if (got := self.seen.get((tag, attributes))) is None:
            got = self._read(tag, attributes)
            if len(self.seen) < 50_000:
                self.seen[tag, attributes] = got
        return got

    @staticmethod
    def _read(tag: str, attributes: str) -> tuple[str, int]:
        label, flags = [], 0
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), entities.unescape(value.strip("\"'"))
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                flags |= 1
            if name not in ("class", "id", "role", "itemprop"):
                continue
            if name in ("class", "id"):
                label.append(f"{name}={value}")
            if tag in ("html", "body"):
                continue
            words = {w.lower() for w in _NAME.findall(value)}
            flags |= (1 if words & BESIDE and not words & AROUND else 0) | (2 if words & HEADING else 0)
            if (name == "role" and words & {"main", "article"}) or (name == "itemprop" and value.lower() == "articlebody"):
                flags |= 4
            elif words & ARTICLE:
                flags |= 8
        flags |= (16 if tag == "form" else 1 if tag in DROPPED else 0) | (2 if tag == "header" else 0) | (4 if tag in ("article", "main") else 0)
        return " ".join(label), flags


class Block:
    """Text with its key, the tag that holds it, the holders around it (numbers and path keys, outermost first), whether it
    stands beside the article, the number of the innermost element that says so, how it is marked, and its characters in links."""

    __slots__ = ("beside", "key", "links", "mark", "named", "parents", "paths", "tag", "text")

    def __init__(self, text: str, key: int, tag: str, parents: tuple[int, ...], paths: tuple[int, ...], beside: int, named: int, mark: int, links: int):
        self.text, self.key, self.tag, self.parents, self.paths, self.beside, self.named, self.mark, self.links = text, key, tag, parents, paths, beside, named, mark, links

    @property
    def mass(self) -> int:
        """Characters that count for a region."""
        return len(self.text) if 2 * self.links <= len(self.text) else 0

    def menu(self, blocks: list[Block]) -> bool:
        """Whether text that is mostly links stands in a list, or where no other text stands: a menu by its make."""
        return self.tag in LISTED or not any(b.mass and b.parents[: len(self.parents)] == self.parents for b in blocks)


def parse(page: str, names: _Names) -> tuple[list[Block], list[int]]:
    """The blocks of text, in page order, and the path key of every element."""
    blocks: list[Block] = []
    elements: list[int] = []
    # open elements: tag, path key, number, beside (1, and 2 in a form), mark (2 article or main, 1 by name, 0), in a link, innermost that is beside
    stack: list[tuple[str, int, int, int, int, bool, int]] = [("", 0, 0, 0, 0, False, 0)]
    parts: list[str] = []
    linked = [0]

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = holder()
                key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), stack[top][1] & 0xFFFFFFFF)
                around = [s for s in stack[1 : top + 1] if s[0] in HOLDERS]
                blocks.append(Block(text, key, stack[top][0], tuple(s[2] for s in around), tuple(s[1] for s in around), stack[-1][3], stack[-1][6], stack[-1][4], linked[0]))
            parts.clear()
            linked[0] = 0

    def holder() -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in BLOCK:
                return i
        return 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if stack[-1][5]:
                linked[0] += len(text)

    def close(tags: set[str], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in within:
                return
            if stack[i][0] in tags:
                del stack[i:]
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and any(s[0] in BLOCK for s in stack[i + 1 :]):
                        break  # an inline end tag does not close blocks
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            end_block()
            if tag in P_ENDERS:
                close({"p"}, frozenset(("td", "button")))
            elif tag in CLOSES:
                close(*CLOSES[tag])
        label, flags = names.of(tag, m[3])
        _, path, _, beside, mark, in_link, named = stack[-1]
        key = xxhash.xxh64_intdigest(f"{path}/{tag}[{label}]".encode("utf-8", "surrogatepass"), 7)
        elements.append(key)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = n if end is None else end.start()
            if end is not None:
                at = n if (close_at := page.find(">", at)) < 0 else close_at + 1
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if flags & 4:
            beside &= ~2  # a form around the whole page
        aside = int(bool(flags & 1) or bool(flags & 2 and not mark)) | 2 * bool(flags & 16)
        mark = max(mark, 2 if flags & 4 else 1 if flags & 8 else 0)
        stack.append((tag, key, len(elements), beside | aside, mark, in_link or tag == "a", len(elements) if aside else named))
    end_block()
    return blocks, elements


def region_of(blocks: list[Block], regions: frozenset[int]) -> int | None:
    """The number of the innermost element of the page that frames the article."""
    best = (-1, None)
    for b in blocks:
        for depth in range(len(b.paths) - 1, best[0], -1):
            if b.paths[depth] in regions:
                best = (depth, b.parents[depth])
                break
    return best[1]


def _varying(blocks: list[Block], template: frozenset[int]) -> list[Block]:
    """Without the template's text, unless nothing else is left."""
    return [b for b in blocks if b.key not in template] or blocks


def slots(blocks: list[Block], template: frozenset[int], regions: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks that are the page's article."""
    frame = region_of(blocks, regions) if regions else None
    inside = [b for b in blocks if frame is not None and frame in b.parents and b.named <= frame]
    held = set(map(id, inside))
    kept = [b for b in blocks if not b.beside or id(b) in held]
    whole = sum(b.mass for b in inside)
    for least in (2, 1):
        marked = [b for b in kept if b.mark >= least]
        if marked and 2 * sum(b.mass for b in marked if id(b) in held) >= whole:
            return [b.text for b in _varying(marked, template)]
    if whole:
        return _with_title(_varying(kept, template), frame)
    return [b.text for b in _varying([b for b in kept if b.mass or not b.menu(kept)], template)]


def _with_title(blocks: list[Block], frame: int | None) -> list[str]:
    """The texts within an element, and a title that stands before it."""
    within = [frame is None or frame in b.parents for b in blocks]
    first = within.index(True) if True in within else 0
    return [b.text for i, b in enumerate(blocks) if within[i] or (i < first and b.tag == "h1")]


def _once(pages: DataFrame) -> DataFrame:
    """host, page (a hash of the html), html: what isn't empty, each once for a host. Only copies are shuffled."""
    at = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    copied = cut(at.groupBy("host", "page").count().where(F.col("count") > 1).select("host", "page"), "copied-pages")
    alone = sized_join(at, copied, ["host", "page"], "left_anti", row_bytes=120)
    return alone.unionByName(sized_join(at, copied, ["host", "page"], "left_semi", row_bytes=120).dropDuplicates(["host", "page"]))


def vectors(pages: DataFrame) -> DataFrame:
    """The tokens of each host, from pages (host, page, html).

    host, token, text (whether it is text), pages, times, the two halves of the occurrence
    vector's sum, mass (characters in it, links left out), whole (those of all its pages),
    depth (holders around it) and parents (their paths, for text).
    """
    numbers = ("pages", "low", "high", "times", "mass", "whole")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = _Names(), {}
        for b in batches:
            for host, page_key, page in zip(b["host"], b["page"], b["html"], strict=True):
                if not page:
                    continue
                blocks, elements = parse(page, names)
                counts: dict[tuple[int, bool], int] = {}
                for key in elements:
                    counts[key, False] = counts.get((key, False), 0) + 1
                mass: dict[tuple[int, bool], int] = {}
                around: dict[int, tuple[int, ...]] = {}
                depth: dict[int, int] = {}
                for block in blocks:
                    counts[block.key, True] = counts.get((block.key, True), 0) + 1
                    mass[block.key, True] = mass.get((block.key, True), 0) + block.mass
                    around[block.key] = block.paths
                    for i, path in enumerate(block.paths):
                        mass[path, False] = mass.get((path, False), 0) + block.mass
                        depth[path] = i + 1
                whole = sum(block.mass for block in blocks)
                seed = page_key & 0xFFFFFFFFFFFFFFFF
                vector = {n: xxhash.xxh64_intdigest(str(n), seed) for n in set(counts.values())}
                for (key, text), n in counts.items():
                    v = vector[n]
                    got = held.get((host, key, text))
                    if got is None:
                        got = held[host, key, text] = [0, 0, 0, 0, 0, 0, 0 if text else depth.get(key, 0), around[key] if text else ()]
                    got[0] += 1
                    got[1] += v & 0xFFFFFFFF
                    got[2] += v >> 32
                    got[3] += n
                    got[4] += mass.get((key, text), 0)
                    got[5] += whole
                    if not text and not got[6]:
                        got[6] = depth.get(key, 0)
                if len(held) > HELD:
                    yield sent(held)
                    held.clear()
        if held:
            yield sent(held)

    def sent(held: dict) -> pd.DataFrame:
        keys = np.fromiter((k[1] for k in held), np.uint64, len(held)).view(np.int64)
        sums = np.array([v[:6] for v in held.values()], np.int64).reshape(-1, 6)
        out = pd.DataFrame({"host": [k[0] for k in held], "token": keys, "text": [k[2] for k in held]} | {c: sums[:, i] for i, c in enumerate(numbers)})
        return out.assign(depth=[v[6] for v in held.values()], parents=[np.array(v[7], np.uint64).view(np.int64) for v in held.values()])

    schema = "host string, token long, text boolean, " + ", ".join(f"{c} long" for c in numbers) + ", depth int, parents array<long>"
    rows = pages.select("host", "page", "html").mapInPandas(run, schema)
    return rows.groupBy("host", "token", "text").agg(*(F.sum(c).alias(c) for c in numbers), F.max("depth").alias("depth"), F.max("parents").alias("parents"))


def templates(pages: DataFrame) -> DataFrame:
    """host, template (the text tokens of the host's valid classes), regions (the elements that frame its articles)."""
    pages = _once(pages)
    sizes = pages.groupBy("host").agg(F.count("*").alias("all_pages"))
    frequent = vectors(pages).where(F.col("pages") >= LEAST_PAGES).join(sizes, "host").where(F.col("pages") >= F.col("all_pages") * LEAST_SHARE)
    frequent = cut(frequent, "frequent-tokens")
    classes = frequent.groupBy("host", "low", "high", "pages").agg(F.count_if(~F.col("text")).alias("elements"), F.count_if("text").alias("texts"))
    valid = classes.where("elements > 0 and texts > 0").select("host", "low", "high", "pages")
    fixed = frequent.where("text").join(valid, ["host", "low", "high", "pages"], "left_semi").select("host", "token", "mass", "parents")
    of_host = fixed.groupBy("host").agg(F.collect_list("token").alias("template"), F.sum("mass").alias("fixed_mass"))
    # where most of the text is fixed, pages are near copies: the root of the pages holds all of it
    alike = frequent.where("not text").groupBy("host").agg(F.max("whole").alias("host_mass"))
    of_host = of_host.join(alike, "host").withColumn("template", F.when(F.col("fixed_mass") < F.col("host_mass") * MOST, F.col("template")).otherwise(F.array().cast("array<long>"))).drop("host_mass")
    of_element = fixed.select("host", "mass", F.explode("parents").alias("token")).groupBy("host", "token").agg(F.sum("mass").alias("inner"))
    # frames: elements that stand once in every page of their class, which holds more elements
    nested = classes.where("elements > 1").select("host", "low", "high", "pages")
    frames = frequent.where("not text and depth > 0 and times = pages").join(nested, ["host", "low", "high", "pages"], "left_semi")
    frames = frames.join(of_host.select("host", "fixed_mass"), "host", "left").join(of_element, ["host", "token"], "left")
    mass = F.col("mass") - F.coalesce("inner", F.lit(0))
    whole = F.col("whole") - F.coalesce("fixed_mass", F.lit(0)) * F.col("pages") / F.col("all_pages")
    regions = frames.where((mass > 0) & (mass >= MOST * whole)).groupBy("host").agg(F.collect_list("token").alias("regions"))
    none = F.array().cast("array<long>")
    return regions.join(of_host, "host", "full").select("host", F.coalesce("template", none).alias("template"), F.coalesce("regions", none).alias("regions"))


def main_text(pages: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of ``pages``.

    Templates of at most ``limit`` bytes are broadcast; else pages and templates meet by host, each host dealt to several tasks.
    """
    found = cut(templates(pages), "templates")
    size = found.agg(F.sum((F.size("template") + F.size("regions")) * 8 + F.octet_length("host") + 64)).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, last, known, frames = _Names(), None, frozenset(), frozenset()
        for b in batches:
            texts = []
            for host, tokens, regions, page in zip(b["host"], b["template"], b["regions"], b["html"], strict=True):
                if host != last:
                    known, frames, last = _keys(tokens), _keys(regions), host
                texts.append(" ".join(slots(parse(page, names)[0], known, frames)) if page else "")
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    source = pages.select(carried("page_id").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = source.join(F.broadcast(found), "host", "left") if size <= limit else salted_join(source, found, "host", F.col("html"))
    return restored(joined.select("page_id", "url", "html", "host", "template", "regions").mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")


def _keys(tokens: np.ndarray | None) -> frozenset[int]:
    return frozenset() if tokens is None else frozenset(np.asarray(tokens, np.int64).view(np.uint64).tolist())
