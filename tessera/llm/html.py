"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: the tags of its elements and the words of its texts, each with the place it stands in
(the chain of elements and their classes). Pages of a host are dealt into groups of at most about GROUP pages, and every
group deduces a template from all its pages:

1. Tokens with equal occurrence vectors (how often they occur in each page) form an equivalence class.
2. A class is kept if it is large and frequent (LEAST tokens, SUPPORT of the pages), if its tokens follow one another
   in the same order in every page, once or cycle after cycle, and if it nests: against each class kept before it
   (most frequent and largest first), either lies in one gap of the other.
3. The kept classes are the template. What stands between consecutive tokens of a class is a slot. A slot whose content
   is the same in every page is part of the template.

The main text is read from the slots. Of the elements that the template has once a page, the main one is found by
going down from the page into the container that holds most words of the slots, as long as no heading and no article
stays outside; what stands outside it, and the blocks in it that are template words alone, is not main text. What
elements, roles, classes and ids call menu, header, footer, sidebar, notice, advert, form or comment goes from it too, and
if it has an article or main element, only that stays (there also text that all pages share, as it is part of each).
Pages without a template, or without its main element, are judged by these names alone.

A host's pages are counted first. Only hosts with more than one group need a number of groups; they are few (one for each
GROUP pages at most) and go to the pages by a broadcast if at most BROADCAST, else by a join that Spark can split.

Defined results: null html and url are empty; pages without a host, and groups with fewer than MIN_PAGES different pages,
have no template; repeated pages, also those that differ only in comments, scripts or attributes, are pages like any
other for the result but do not add support; other columns are ignored.
"""

from __future__ import annotations

import html as entities
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .markup import Event, Places, parse

#: Least different pages that show a template, least share of them that a class occurs in, and least tokens of a class.
MIN_PAGES, SUPPORT, LEAST = 6, 0.6, 3
#: Pages of a group, and bytes of html, about.
GROUP, GROUP_BYTES = 256, 4 << 20
BROADCAST = 200_000
#: Bytes of html for each task.
SHARE = 32 << 20
#: Least share of the slots' words that a container holds to be gone into.
MOST = 0.5
CONTAINERS = frozenset("article body div main section td".split())


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


@dataclass(slots=True)
class Page:
    """Tokens as numbers that the pages of a group share, and the stretch of them that each text has."""

    tokens: np.ndarray
    texts: list[tuple[Event, int, int]]


class _Words(dict):
    """Numbers for the tokens of one kind and place."""

    def __init__(self, each: list[tuple[str, int]], what: tuple[str, int]):
        self.each, self.what = each, what

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.each)
        self.each.append(self.what)
        return n


class Tokens:
    """Numbers for tokens; each has the kind and place of every number."""

    def __init__(self):
        self.places, self.each = Places(), []
        self.known: dict[tuple[str, int], _Words] = {}

    def page(self, text: str) -> Page:
        events, numbers, texts = parse(text, self.places), [], []
        for e in events:
            known = self.known.get((e.kind, e.path)) or self.known.setdefault((e.kind, e.path), _Words(self.each, (e.kind, e.path)))
            if e.kind == "text":
                first = len(numbers)
                numbers.extend(map(known.__getitem__, entities.unescape(e.text).split()))
                texts.append((e, first, len(numbers)))
            else:
                numbers.append(known[""])
        return Page(np.array(numbers, np.int64), texts)


@dataclass
class Template:
    """classes: tokens of each kept class in order. fixed: whether the slot after each is the same in all pages."""

    classes: list[list[int]] = field(default_factory=list)
    fixed: list[list[bool]] = field(default_factory=list)
    #: Class and position of each token.
    at: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: Open and close token of the main element, if one was found.
    main: tuple[int, int] | None = None


class Pages:
    """Different pages of a host as one array of tokens."""

    def __init__(self, pages: list[np.ndarray]):
        self.n = len(pages)
        self.flat = np.concatenate(pages or [np.zeros(0, np.int64)])
        self.ends = np.cumsum([len(p) for p in pages], dtype=np.int64)
        self.of = np.repeat(np.arange(self.n), [len(p) for p in pages])

    def classes(self) -> list[np.ndarray]:
        """Tokens grouped by equal occurrence vectors, of those in enough pages: most frequent first, then largest."""
        pairs, count = np.unique(self.flat * self.n + self.of, return_counts=True)
        token, page = np.divmod(pairs, self.n)
        support = np.bincount(token)
        often = np.flatnonzero(support >= max(MIN_PAGES, SUPPORT * self.n))
        if not len(often):
            return []
        row = np.full(len(support), -1)
        row[often] = np.arange(len(often))
        vectors = np.zeros((len(often), self.n), np.int64)
        hit = row[token] >= 0
        vectors[row[token[hit]], page[hit]] = count[hit]
        of = np.unique(vectors, axis=0, return_inverse=True)[1].ravel()
        classes = [often[of == c] for c in range(of.max() + 1)]
        return sorted((c for c in classes if len(c) >= LEAST), key=lambda c: (-support[c[0]], -len(c), c[0]))

    def first(self, positions: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many of positions are before each of the pages in of."""
        return np.searchsorted(positions, np.concatenate([[0], self.ends])[of])

    def in_one_gap(self, inner: np.ndarray, cycle: int, outer: np.ndarray, size: int) -> bool:
        """Whether each cycle of inner's tokens lies between the same two tokens of outer (size a cycle) in every page."""
        of = self.of[inner]
        k, whole = np.searchsorted(outer, inner) - self.first(outer, of), self.first(outer, of + 1) - self.first(outer, of)
        if (k.reshape(-1, cycle) != k[::cycle, None]).any():
            return False
        gap = np.where(k == 0, -1, np.where(k == whole, -2, k % size))
        return len(np.unique(gap[whole > 0])) <= 1

    def nested(self) -> list[tuple[list[int], np.ndarray]]:
        """The kept classes: tokens in order, and where they are."""
        kept: list[tuple[list[int], np.ndarray]] = []
        for tokens in self.classes():
            at = np.flatnonzero(np.isin(self.flat, tokens))
            order = self.flat[at[: len(tokens)]]  # equal vectors, so every page has whole cycles if the order holds
            if len(np.unique(order)) < len(order) or (self.flat[at].reshape(-1, len(order)) != order).any():
                continue
            if all(self.in_one_gap(at, len(order), other, len(o)) or self.in_one_gap(other, len(o), at, len(order)) for o, other in kept):
                kept.append((order.tolist(), at))
        return kept

    def fixed_slots(self, order: list[int], at: np.ndarray) -> list[bool]:
        """Of the slot after each token of a class: whether all pages have the same in it."""
        out, n = [], len(order)
        for k in range(n):
            a = at[k::n]
            b = at[k + 1 :: n][: len(a)]
            a = a[: len(b)]
            same = self.of[a] == self.of[b]
            a, size = a[same], (b - a)[same]
            fixed = len(a) > 0 and (size == size[0]).all()
            if fixed:
                inner = self.flat[a[:, None] + np.arange(1, size[0])]
                fixed = (inner == inner[0]).all()
            out.append(bool(fixed))
        return out


def deduce(pages: list[np.ndarray], tokens: Tokens) -> Template:
    """The template of different pages of a host."""
    out = Template()
    if len(pages) < MIN_PAGES:
        return out
    all_ = Pages(pages)
    for order, at in all_.nested():
        out.at |= {t: (len(out.classes), k) for k, t in enumerate(order)}
        out.classes.append(order)
        out.fixed.append(all_.fixed_slots(order, at))
    out.main = _main_element(all_, tokens, out)
    return out


def _main_element(pages: Pages, tokens: Tokens, template: Template) -> tuple[int, int] | None:
    """The container to which most words of the slots lead, as its open and close token."""
    places = tokens.places
    path = np.array([p for _, p in tokens.each], np.int64)
    text = np.array([k == "text" for k, _ in tokens.each], bool)
    slot = text & ~np.array(places.boilerplate, bool)[path]
    slot[list(template.at)] = False
    marks = np.stack([slot, slot & np.array(places.heading, bool)[path], text & np.array(places.article, bool)[path]], 1)
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(marks[pages.flat], 0, dtype=np.int64)])  # slots' words, those in headings, words in articles
    pairs = {tokens.each[t]: t for t in template.at if tokens.each[t][0] != "text"}
    inside = []
    for (kind, p), start in pairs.items():
        end = pairs.get(("close", p))
        if kind != "open" or end is None or places.boilerplate[p] or places.names[p] not in CONTAINERS:
            continue
        a, b = np.flatnonzero(pages.flat == start), np.flatnonzero(pages.flat == end)
        if len(np.unique(pages.of[a])) == len(a):  # once a page
            span = np.full((pages.n, 2), -1)
            span[pages.of[a]] = np.stack([a, b], 1)
            inside.append((start, end, span))
    found, span = None, np.stack([np.concatenate([[-1], pages.ends[:-1] - 1]), pages.ends], 1)
    while True:
        choice = None
        for start, end, inner in inside:
            has = inner[:, 0] >= 0
            if ((inner[has, 0] > span[has, 0]) & (inner[has, 1] < span[has, 1])).all():
                words = (sums[inner[has, 1]] - sums[inner[has, 0]]).sum(0)
                whole = (sums[span[has, 1]] - sums[span[has, 0] + 1]).sum(0)
                if words[0] and words[0] >= MOST * whole[0] and words[1] == whole[1] and words[2] == whole[2]:
                    rank = (words[0], (inner[has, 1] - inner[has, 0]).sum())
                    if choice is None or rank > choice[0]:
                        choice = rank, (start, end), inner
        if choice is None:
            return found
        _, found, span = choice


def _template_blocks(page: Page, template: Template) -> set[tuple[int, int]]:
    """Blocks all of whose words are template words that follow one another, with a fixed slot on one side."""
    words: dict[tuple[int, int], list[int]] = {}
    for e, first, end in page.texts:
        words.setdefault(e.block, []).extend(page.tokens[first:end].tolist())
    out = set()
    for block, of in words.items():
        places = [template.at.get(t) for t in of]
        if not places or None in places or len({c for c, _ in places}) != 1:
            continue
        c, ks = places[0][0], [k for _, k in places]
        fixed = template.fixed[c]
        if all(a < b for a, b in zip(ks, ks[1:])) and all(fixed[ks[0] : ks[-1]]) and (fixed[ks[-1]] or fixed[ks[0] - 1]):
            out.add(block)
    return out


def main_text(page: Page, template: Template) -> str:
    texts = page.texts
    if template.main:
        start, end = (np.flatnonzero(page.tokens == t) for t in template.main)
        if len(start) == 1 and len(end) == 1:
            texts = [t for t in texts if start[0] < t[1] <= end[0]]
    texts = [t for t in texts if not t[0].boilerplate]
    if any(e.article for e, first, end in texts if end > first):
        texts = [t for t in texts if t[0].article]
    elif template.at:
        gone = _template_blocks(page, template)
        texts = [t for t in texts if t[0].block not in gone]
    blocks: list[list] = []
    for e, _, _ in texts:
        if blocks and blocks[-1][0] == e.block:
            blocks[-1][1].append(e.text)
        else:
            blocks.append([e.block, [e.text]])
    return "\n".join(t for _, raws in blocks if (t := _clean("".join(raws))))


def texts_of(htmls: list[str], same_host: bool) -> list[str]:
    """Main texts of a group of pages."""
    tokens = Tokens()
    pages = [tokens.page(h) for h in htmls]
    different = {p.tokens.tobytes(): p.tokens for p in pages}  # a repeated page adds no support
    template = deduce(list(different.values()), tokens) if same_host else Template()
    return [main_text(p, template) for p in pages]


def _group_texts(group: pa.Table) -> pa.Table:
    texts = texts_of([h or "" for h in group["html"].to_pylist()], bool(group["host"][0].is_valid))
    return group.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = pages.select("page_id", "url", "html", F.when(host != "", host).alias("host"))
    scratch = Scratch(spark)
    bytes_ = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)))
    sizes = scratch.cut(pages.groupBy("host").agg(F.count("*").alias("n"), bytes_.alias("bytes")))
    large = sizes.select(F.col("host").alias("large_host"), F.greatest(F.expr(f"n div {GROUP}"), F.expr(f"bytes div {GROUP_BYTES}")).alias("more")).filter("more > 0")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (sizes.agg(F.sum("bytes")).first()[0] or 0) // SHARE)
    few = large.limit(BROADCAST + 1).count() <= BROADCAST
    # pages of a host are dealt by what they are, so that the same pages meet however the table is split
    what = F.when(F.col("host").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("page_id", "url", F.coalesce("html", F.lit(""))))
    dealt = F.pmod(what, F.coalesce("more", F.lit(0)) + 1)
    placed = pages.join(F.broadcast(large) if few else large, F.col("host").eqNullSafe(F.col("large_host")), "left")
    placed = placed.select("page_id", "url", "html", "host", dealt.alias("deal"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema) + ", text string"
    return placed.repartition(tasks, "host", "deal").groupBy("host", "deal").applyInArrow(_group_texts, schema)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
