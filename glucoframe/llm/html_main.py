"""Main text of web pages by the repeats of each whole host.

Pages become blocks of words, each with the zone it stands in: the article (or
main element), page furniture (menus, footers, adverts, forms, ... by element,
role or class name), or neither. Names count as whole tokens and not on html, body,
article and main; a main element, and an article with more words than the page has
in its main zone otherwise, ends furniture that only a name opened. The text is the
blocks of the article, or of all but the furniture on pages without an article, less
the blocks that repeat over the host.

Repeats are those of the host's suffix array, sorted to the depth of ``LEAST_RUN``
words: suffixes of equal rank (``suffix_ranks``) are equal windows of that length. The
array itself is never put together. Every page sends the hashes of its windows, Spark
counts the distinct pages of each (host, window), and neighbouring repeated windows
unite to runs again when the pages are read a second time; so a host of any size is
counted whole, in groups that are aggregated before they move. Pages with the same
text zone are copies and count once.

* Outside articles a block goes if runs cover all of its words that stand outside
  articles on ``least_pages`` of the host's distinct pages: one in ``PLAIN_SHARE``, at
  least five, on small hosts more than half and at least three. It stays if it is a
  block of as many articles: a copied passage, not furniture.
* In articles a block of ``LEAST_RUN`` or more words goes if it is a block of the
  articles of more than half of the host's distinct pages, and of five at least.

Passages shared by fewer pages stay, and so do parts of blocks.

Defined results: null html is empty; a null or odd url has the host ""; pages with
equal ids are separate pages; unclosed elements end with their parent; words compare
by 64-bit hashes, without the case of A to Z in windows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.scratch import Scratch
from glucoframe.llm.textstream import mix, release_memory, seeded, slices, text_buffers, windows, word_stream

LEAST_RUN = 8
PAGES = 256
PLAIN_SHARE = 1000
BROADCAST_UNITS = 1_000_000
SLICE_BYTES = 4 << 20
MAIN, PLAIN, FURNITURE = 0, 1, 2
_NAMED, _NESTED = 3, 4  # while parsing: furniture by its name alone, an article in it

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|head)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>", re.I | re.S)
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
#: elements that end a block
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form menu button dialog fieldset".split())
_MAIN = frozenset(("article", "main"))
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: a whole class, id or role: whose, what and which container of it; "has-sidebar", "related-posts-on",
#: "notice-of-award" or "share-price" say something else
_NAME = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|user|reader|post|article|blog|cookie|gdpr|privacy|email|"
    r"mobile|sticky)[-_])?"
    r"(?:ad|ads|adsbygoogle|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|gdpr|menu|"
    r"modal|nav|navbar|navigation|newsletter|notices?|popup|promo|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|"
    r"widget)"
    r"(?:[-_](?:area|articles|banner|bar|block|box|buttons?|consent|container|form|icons?|inner|item|left|links|list|media|modal|notice|"
    r"overlay|popup|posts|primary|respond|right|secondary|section|signup|slot|stories|thread|unit|widget|wrap|wrapper))*", re.I)
_UNNAMED = frozenset(("html", "body", "article", "main"))


def named_furniture(attributes: str) -> bool:
    return any(_NAME.fullmatch(token) for m in _ATTRIBUTE.finditer(attributes) for token in (m[1] or m[2] or m[3] or "").split())


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, words joined by one space) of every block with words, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = PLAIN

    def close():
        words = entities.unescape("".join(parts)).split()
        parts.clear()
        if words:
            out.append((zone, " ".join(words)))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        raw = m[1] and m[1].lower()
        if raw == "head" or m[3] and m[3].lower() == "head":
            continue
        if raw:
            end = _RAW_END[raw].search(page, at)
            at = end.end() if end else n
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCKS:
            close()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    zone = stack[i][1]
                    del stack[i:]
                    break
        elif tag not in _VOID and not m[4].endswith("/") and (tag in _BLOCKS or tag in _FURNITURE):
            if tag == "p" and stack and stack[-1][0] == "p":
                zone = stack.pop()[1]
            stack.append((tag, zone))
            if zone != FURNITURE:
                if tag in _FURNITURE or tag == "header" and zone not in (MAIN, _NESTED):
                    zone = FURNITURE
                elif tag in _MAIN:
                    zone = _NESTED if tag == "article" and zone in (_NAMED, _NESTED) else MAIN
                elif tag not in _UNNAMED and zone != _NAMED and named_furniture(m[4]):
                    zone = _NAMED
    close()
    # the page's article in a wrapper with an unlucky name, or teasers in a list of related pages
    length = {z: sum(t.count(" ") + 1 for y, t in out if y == z) for z in (MAIN, _NESTED)}
    final = {_NAMED: FURNITURE, _NESTED: MAIN if length[_NESTED] > length[MAIN] else FURNITURE}
    return [(final.get(z, z), t) for z, t in out]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens (a power of two), by prefix doubling.
    Negative tokens are separators: each is different from all others."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        nxt = np.full(len(rank), -1, np.int64)
        nxt[:-length] = rank[length:]
        rank = np.unique((rank + 1) * (len(rank) + 2) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        length *= 2
    return rank


#: what is counted: windows outside articles, whole blocks in and outside articles, pages
WINDOW, INSIDE, OUTSIDE, PAGE = range(4)


class _Slice:
    """Blocks of some pages, with the keys of what can repeat."""

    def __init__(self, pages: list[str | None], hosts: np.ndarray):
        self.pages = [page_blocks(h) if h else [] for h in pages]
        self.main = [any(z == MAIN for z, _ in blocks) for blocks in self.pages]
        self.hosts = hosts
        self.page = np.repeat(np.arange(len(pages)), [len(blocks) for blocks in self.pages])
        self.zone = np.array([z for blocks in self.pages for z, _ in blocks], np.int64)
        self.texts = [t for blocks in self.pages for _, t in blocks]

    def bodies(self) -> np.ndarray:
        """Key of the zone that the text of each page is taken from."""
        return np.array([_key("\n".join([str(m), *(t for z, t in blocks if z == (MAIN if m else PLAIN))]))
                         for m, blocks in zip(self.main, self.pages)], np.uint64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, key) of each window outside articles; the first word of each block and the end.
        Windows do not go on from one zone into another, nor into the next page."""
        words = word_stream(pa.array(self.texts, pa.large_string()))
        block = np.repeat(np.arange(len(self.texts)), words.counts)
        stretch = np.cumsum(np.r_[True, (np.diff(self.page) != 0) | (np.diff(self.zone) != 0)])[block] if len(block) else block
        last = LEAST_RUN - 1
        if len(block) <= last:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), words.first
        at = np.flatnonzero((stretch[last:] == stretch[:-last]) & (self.zone[block[:-last]] != MAIN))
        return at, self._of_host(windows(words.hashes, LEAST_RUN)[at], block[at], WINDOW), words.first

    def blocks(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number, key) of the blocks of ``LEAST_RUN`` or more words."""
        at = np.array([i for i, (t, z) in enumerate(zip(self.texts, self.zone.tolist()))
                       if (z == MAIN) == inside and t.count(" ") >= LEAST_RUN - 1], np.int64)
        return at, self._of_host(np.array([_key(self.texts[i]) for i in at], np.uint64), at, INSIDE)

    def _of_host(self, hashes: np.ndarray, block: np.ndarray, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(hashes + seeded(self.hosts[self.page[block]].view(np.uint64), 50 + seed))


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _slices(batch: pa.RecordBatch):
    """(first page, pages) in slices of bounded size."""
    html = batch.column("html")
    hosts = batch.column("host").to_numpy()
    for i, j in slices(text_buffers(html)[1], SLICE_BYTES):
        yield i, _Slice(html.slice(i, j - i).to_pylist(), hosts[i:j])


def _units(batches):
    """Rows (host, kind, unit, body): what can repeat, once per page."""
    for batch in batches:
        for _, part in _slices(batch):
            body = part.bodies()
            at, key, first = part.windows()
            block = np.searchsorted(first, at, side="right") - 1
            found = [(WINDOW, part.page[block], key)]
            for kind in (INSIDE, OUTSIDE):
                at, key = part.blocks(kind == INSIDE)
                found.append((kind, part.page[at], key))
            found.append((PAGE, np.arange(len(body)), np.zeros(len(body), np.uint64)))
            for kind, page, key in found:
                rows = np.unique(np.stack([page.astype(np.uint64), key]), axis=1)
                page = rows[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.hosts[page]), pa.array(np.full(len(page), kind, np.int32)), pa.array(rows[1].view(np.int64)),
                     pa.array(body[page].view(np.int64))], ["host", "kind", "unit", "body"])
    release_memory()


def _main_texts(part: _Slice, gone: dict[int, np.ndarray]) -> list[str]:
    """Texts of the pages; ``gone`` has the sorted keys of repeated windows, of blocks that
    go in articles, and of blocks that stay outside them."""
    drop = np.zeros(len(part.texts), bool)
    if len(gone[WINDOW]):
        at, key, first = part.windows()
        edge = np.zeros(first[-1] + 1, np.int64)
        hit = at[_among(key, gone[WINDOW])]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + LEAST_RUN, -1)
        covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
        drop = (covered[first[1:]] - covered[first[:-1]] == np.diff(first)) & (part.zone != MAIN)
        at, key = part.blocks(False)
        drop[at[_among(key, gone[OUTSIDE])]] = False
    if len(gone[INSIDE]):
        at, key = part.blocks(True)
        drop[at[_among(key, gone[INSIDE])]] = True
    kept: list[list[str]] = [[] for _ in part.pages]
    for i, z, text, d in zip(part.page.tolist(), part.zone.tolist(), part.texts, drop.tolist()):
        if not d and z == (MAIN if part.main[i] else PLAIN):
            kept[i].append(text)
    return ["\n".join(k) for k in kept]


def _among(keys: np.ndarray, those: np.ndarray) -> np.ndarray:
    if not len(those):
        return np.zeros(len(keys), bool)
    return those[np.minimum(np.searchsorted(those, keys), len(those) - 1)] == keys


def _sorted_keys(kind: np.ndarray, unit: np.ndarray) -> dict[int, np.ndarray]:
    return {k: np.sort(unit[kind == k].view(np.uint64)) for k in (WINDOW, INSIDE, OUTSIDE)}


def _texts_by_broadcast(batches, table):
    gone = table.value
    for batch in batches:
        texts = [t for _, part in _slices(batch) for t in _main_texts(part, gone)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    release_memory()


def _texts_of_part(pages: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    """The same for one part of a host."""
    gone = _sorted_keys(units["kind"].to_numpy(), units["unit"].to_numpy(np.int64))
    batch = pa.RecordBatch.from_pandas(pages[["html", "host"]], preserve_index=False).cast(
        pa.schema([("html", pa.string()), ("host", pa.int64())]))
    texts = [t for _, part in _slices(batch) for t in _main_texts(part, gone)]
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def least_pages(n):
    """Distinct pages of ``n`` on which a run outside articles is furniture."""
    few = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n / 2) + 1))
    return F.greatest(few, F.ceil(n / PLAIN_SHARE))


def _gone(counts: DataFrame) -> DataFrame:
    """(host, kind, unit): windows and blocks in articles that go, blocks outside that stay."""
    sizes = counts.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("n"))
    windows_ = counts.where(F.col("kind") == WINDOW).join(sizes, "host").where(F.col("pages") >= least_pages(F.col("n")))
    inside = counts.where(F.col("kind") == INSIDE)
    common = inside.join(sizes, "host").where((F.col("pages") >= 5) & (2 * F.col("pages") > F.col("n")))
    outside = counts.where(F.col("kind") == OUTSIDE).select("host", "unit", F.col("pages").alias("out"))
    copied = (outside.join(inside, ["host", "unit"]).where("pages >= out")
              .select("host", F.lit(OUTSIDE).alias("kind"), "unit"))
    return (windows_.select("host", "kind", "unit").unionByName(common.select("host", "kind", "unit")).unionByName(copied))


def main_texts(pages: DataFrame, part_pages: int = PAGES, broadcast_units: int = BROADCAST_UNITS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "main-text")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(host).alias("host"))
    units = pages.select("html", "host").mapInArrow(_units, "host long, kind int, unit long, body long")
    counts = units.groupBy("host", "kind", "unit").agg(F.countDistinct("body").alias("pages"))
    # fewer than three pages decide nothing, but for blocks that stand outside articles once or twice
    counts = scratch.stored(counts.where((F.col("pages") > 2) | (F.col("kind") == OUTSIDE)))
    gone = scratch.stored(_gone(counts))
    schema = "page_id long, url string, text string, n_chars long"
    if gone.count() <= broadcast_units:
        rows = gone.toArrow()
        keys = _sorted_keys(rows.column("kind").to_numpy(), rows.column("unit").to_numpy())
        table = pages.sparkSession.sparkContext.broadcast(keys)
        return pages.mapInArrow(partial(_texts_by_broadcast, table=table), schema)
    # a host's repeated units are few next to its pages: they go to all of its parts
    parts = pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / part_pages).cast("int").alias("parts"))
    dealt = (pages.join(F.broadcast(parts.where("parts > 1")) if parts.count() <= broadcast_units else parts, "host", "left")
             .withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"))
    copies = gone.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return (dealt.groupBy("host", "part").cogroup(copies.groupBy("host", "part"))
            .applyInPandas(_texts_of_part, schema))
