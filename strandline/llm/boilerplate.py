"""Main text of web pages by suffix arrays over the pages of a host.

A page is read into blocks with the place that its markup gives them: in the article, in page furniture
(menu, footer, advert, comments ...), or open. The token streams of a host's pages are one array whose
suffixes are sorted; neighbours that agree in LEAST tokens and come from distinct pages are long repeated
substrings. Furniture goes; open blocks go where repeats cover them and stay where they are unique;
blocks of a marked article stay, as an article may be on several pages.

A host of many pages is compared in stretches, each with a suffix array of its own; what pages of distinct
stretches share is found by keys of the suffixes' first tokens, so the answer is that of one array.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import blake2b
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.url_filters import host_of
from strandline.operators.components import cut_lineage

#: Tokens of a repeated substring; share of a block's tokens that repeats must cover for it to go; share of a page's open tokens from which on the page is a copy.
LEAST, COVERED, COPY = 12, 0.5, 0.8
#: Tokens of an anchor: equal windows of LEAST tokens have equal least keys of their windows of so many.
ANCHOR = 6
#: Characters of pages of a host that one suffix array holds, from this to twice as many; hosts that are dealt over several tasks are fewer than LARGE_HOSTS. Neither moves a result.
GROUP_CHARS, LARGE_HOSTS = 1 << 20, 65_536
#: Stretches of a host that one range of keys is compared for at a time: a host of more has more ranges.
MEETING = 128

# Element names.
RAW_TEXT = "script|style|noscript|template|iframe|svg|math|object|canvas|audio|video|select|textarea|title|noembed|noframes|xmp"
FURNITURE = frozenset("nav header footer aside form dialog menu button datalist label legend fieldset head".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body html aside nav header footer form table td th ul ol menu dl blockquote details dialog figure fieldset button center".split())
# elements that end an open element of the same set, up to the next container
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of a class, id or role that mark page furniture; those of comments do so around articles, too.
COMMENTS = frozenset("comment comments commentlist disqus replies respond discussion".split())
WORDS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended widget login signup signin search toolbar pagination pager skip contentinfo complementary alert".split()
)

_TAG = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<({RAW_TEXT})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</[^a-z>][^>]*>", re.I | re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

OPEN, ARTICLE, GONE = 0, 1, 2


class Block(NamedTuple):
    place: int
    name: str  # of the element that it begins in
    text: str


def _marked(name: str, attributes: str) -> int:
    """1 for page furniture by its attributes, 2 for reader comments, else 0."""
    if not attributes or name in ("html", "body", "main"):
        return 0
    words = {w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")} & WORDS
    if name in ("article", "h1", "h2", "h3", "h4", "h5", "h6"):
        words &= COMMENTS
    if words & COMMENTS:
        return 2
    return int(bool(words) or bool(_HIDDEN.search(attributes)))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space made one space, character references decoded; without scripts, styles and the like.

    Unclosed elements end as a browser ends them (about: paragraphs at the next block, list items and
    cells at the next one, all at the end of what holds them); end tags without a start are ignored.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # (element, place inside it)
    count: Counter[str] = Counter()
    held: list[str] = []
    begins = "body"

    def place() -> int:
        return stack[-1][1] if stack else OPEN

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(place(), begins, text))

    def pop() -> None:
        if held and stack[-1][1] != (stack[-2][1] if len(stack) > 1 else OPEN):
            flush()
        count[stack.pop()[0]] -= 1

    def close(names: tuple[str, ...]) -> None:
        """End the nearest of these elements inside the present container."""
        if any(count[n] for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in CONTAINERS:
                    return

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
            begins = name
        if m[2]:
            if name in CONTAINERS:
                if count[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            elif name not in VOID:
                close((name,))
            continue
        if name in BLOCKS:
            close(("p",))
        if name in ENDS:
            close(ENDS[name])
        if name in VOID:
            continue
        now, mark = place(), _marked(name, m[4])
        if name == "main" or name == "article" and now == OPEN:
            now = GONE if mark == 2 or any(p == GONE and n in FURNITURE for n, p in stack) else ARTICLE
        elif mark or name in FURNITURE:
            now = GONE
        elif now == GONE and name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1][0] in ("header", "hgroup"):
            # an article's heading may stand in a header of its own
            outside = [p for n, p in stack if n not in ("header", "hgroup")]
            now = ARTICLE if outside and outside[-1] == ARTICLE else GONE
        if now != place():
            flush()
        stack.append((name, now))
        count[name] += 1
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which tokens lie in a substring of at least so many tokens that distinct pages hold.

    tokens: numbers of all pages in a row; page: the page of each. Suffixes are sorted by doubling until
    least tokens of each are compared; a page's end differs from everything.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if not n:
        return covered
    last = np.concatenate([np.flatnonzero(page[1:] != page[:-1]), [n - 1]])
    # each page's end is a token of its own behind all others, and so is the array's
    ends = np.searchsorted(last, np.arange(n))
    left = last[ends] - np.arange(n) + 1
    rank, known = tokens.astype(np.int64), 1
    top = int(rank.max()) + 1
    while known < least:
        step = min(known, least - known)
        ahead = np.minimum(np.arange(n) + step, n - 1)
        behind = np.where(left > step, rank[ahead], top + ends)
        key = rank * (top + len(last)) + behind
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        top, known = int(new[-1]) + 1, known + step
    order = np.argsort(rank, kind="stable")  # the suffix array, by the first least tokens
    first = np.concatenate([[0], np.flatnonzero(rank[order][1:] != rank[order][:-1]) + 1])
    pages = page[order]
    several = np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first)
    starts = order[np.repeat(several, np.diff(np.append(first, n)))]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts[left[starts] >= least], 1)
    np.add.at(change, starts[left[starts] >= least] + least, -1)
    return np.cumsum(change[:-1]) > 0


def _covering(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in a window of LEAST tokens from one of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LEAST, -1)
    return np.cumsum(change[:-1]) > 0


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are wanted."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    wanted = np.sort(wanted)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _changing(keys: np.ndarray) -> np.ndarray:
    """Distinct keys; neighbours that are equal, as anchors mostly are, are not sorted."""
    return np.unique(keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]])


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, by planes of bytes."""
    return zlib.compress(np.diff(keys.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Found(NamedTuple):
    text: str
    tokens: int
    covered: int


class Stretch:
    """Distinct pages of one host, by the number of each, as one row of tokens: a mark of each block's element and its words.

    A page that other stretches hold, too, is at home in one of them only.
    """

    def __init__(self, pages: dict[int, list[Block]], home: Callable[[int], bool] = lambda number: True):
        self.pages, self.home = pages, np.array([home(n) for n in pages], bool)
        # texts have one space between words and none around them
        self.sizes = [[b.text.count(" ") + 2 for b in blocks] for blocks in pages.values()]
        totals = [sum(s) for s in self.sizes]
        words = pc.split_pattern(pa.array([" ".join([f"<{b.name}> {b.text}" for b in blocks]) for blocks in pages.values() if blocks], pa.large_string()), " ").flatten().dictionary_encode()
        self.tokens, self.words = words.indices.to_numpy().astype(np.int64), words.dictionary
        self.page = np.repeat(np.arange(len(pages)), totals)
        left = np.repeat(np.cumsum(totals, dtype=np.int64), totals) - np.arange(len(self.tokens))
        self.starts = np.flatnonzero(left >= LEAST)  # of windows of LEAST tokens

    @cached_property
    def numbers(self) -> np.ndarray:
        """A number of each token, the same in all stretches."""
        return pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)[self.tokens]

    def _keys(self, width: int) -> np.ndarray:
        """A key of the tokens in the window of this width at each token; zeros follow the last token."""
        row = np.concatenate([self.numbers, np.zeros(width, np.uint64)])
        key = np.zeros(len(self.tokens), np.uint64)
        for k in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + row[k : k + len(key)]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
        return (key ^ (key >> np.uint64(31))).view(np.int64)

    @cached_property
    def windows(self) -> np.ndarray:
        """The key of each window of LEAST tokens."""
        return self._keys(LEAST)[self.starts]

    @cached_property
    def anchors(self) -> np.ndarray:
        """The least key among the anchors of each window; anchors only name windows to look at, so the upper 40 bits do."""
        keys = self._keys(ANCHOR) & -(1 << 24)
        least = keys[self.starts]
        for k in range(1, LEAST - ANCHOR + 1):
            np.minimum(least, keys[self.starts + k], out=least)
        return least

    def distinct(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows under these anchors: each key once, in order, and on how many of the pages at home it is (2 for more)."""
        at = np.flatnonzero(_among(self.anchors, anchors))
        order = at[np.argsort(self.windows[at], kind="stable")]
        keys = self.windows[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        if not len(first):
            return keys, np.zeros(0, np.uint8)
        pages = self.page[self.starts[order]]
        home = self.home[pages]
        least = np.minimum.reduceat(np.where(home, pages, len(self.pages)), first)
        most = np.maximum.reduceat(np.where(home, pages, -1), first)
        return keys[first], (1 + np.sign(most - least)).astype(np.uint8)

    def found(self, elsewhere: np.ndarray) -> dict[int, Found]:
        """The main text of each page, with its tokens and how many of them repeats cover: here, and windows of these keys."""
        hit_tokens = repeated(self.tokens, self.page)
        if len(elsewhere):
            hit_tokens |= _covering(self.starts[_among(self.windows, elsewhere)], len(self.tokens))
        covered = np.cumsum(np.concatenate([[0], hit_tokens]))
        at, out = 0, {}
        for (number, blocks), size in zip(self.pages.items(), self.sizes, strict=True):
            ends = at + np.cumsum([0, *size])
            hit = (covered[ends[1:]] - covered[ends[:-1] + 1]).tolist()  # words of each block
            at, hits = int(ends[-1]), int(covered[ends[-1]] - covered[at])
            kept = [b.text for b in blocks if b.place == ARTICLE]
            if not kept:
                open_ = [(b.text, n, h) for b, n, h in zip(blocks, size, hit, strict=True) if b.place == OPEN]
                copy = sum(h for _, _, h in open_) >= COPY * sum(n - 1 for _, n, _ in open_)
                kept = [t for t, n, h in open_ if copy or h < COVERED * (n - 1)]
            out[number] = Found("\n".join(kept), sum(size), hits)
        return out


NONE = np.zeros(0, np.int64)


def extract(pages: list[str]) -> list[Found]:
    """The main text of each page of one host, with its tokens and how many of them repeats cover; equal pages are one."""
    numbers = [_number(p) for p in pages]
    found = Stretch({n: blocks_of(p) for n, p in dict(zip(numbers, pages, strict=True)).items()}).found(NONE)
    return [found[n] for n in numbers]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages are read into blocks, which are packed; page is the page's number, again says that the batch has the page in a row before."""
    for batch in batches:
        seen: set[int] = set()
        pages = [p or "" for p in batch.column("html").to_pylist()]
        packed = [zlib.compress(json.dumps(blocks_of(p), ensure_ascii=False).encode("utf-8", "surrogatepass"), 4) for p in pages]
        numbers = [_number(p) for p in pages]
        again = [n in seen or seen.add(n) is not None for n in numbers]
        columns = [*(batch.column(c) for c in ("host", "page_id", "url")), pa.array(numbers, pa.int64()), pa.array(again, pa.bool_()), pa.array(map(len, pages), pa.int64()), pa.array(packed, pa.binary())]
        yield pa.record_batch(columns, names=["host", "page_id", "url", "page", "again", "chars", "blocks"])


class Rows(NamedTuple):
    host: str
    part: int
    parts: int
    ids: list
    urls: list
    pages: list[int]
    stretch: Stretch
    keys: np.ndarray
    alone: bool  # all pages of the host are here


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows come sorted by host, part and page, with the part's keys in its first; those of one part are taken together, in stretches of GROUP_CHARS to twice as many.

    Rows of equal pages are in one stretch and count once.
    """
    now, rows, chars, keys, cut = None, [], 0, NONE, False

    def taken(rows: list[tuple], alone: bool) -> Rows:
        read = {}
        for _, _, number, _, blocks in rows:
            if number not in read:
                read[number] = blocks_of(blocks) if isinstance(blocks, str) else [Block(*b) for b in json.loads(zlib.decompress(blocks).decode("utf-8", "surrogatepass"))]
        host, part, parts = now
        return Rows(host, part, parts, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], Stretch(read, lambda number: number % parts == part), keys, alone and parts == 1)

    for batch in batches:
        names, columns = batch.schema.names, {c: batch.column(c) for c in batch.schema.names}
        for i in range(len(batch)):
            key = (columns["host"][i].as_py(), columns["part"][i].as_py(), columns["parts"][i].as_py() if "parts" in names else 1)
            if key != now:
                if rows:
                    yield taken(rows, not cut)
                now, rows, chars, keys, cut = key, [], 0, NONE, False
            if "keys" in names and columns["keys"][i].is_valid:
                keys = np.concatenate([_unpacked(k) for k in columns["keys"][i].as_py()])
            if "blocks" in names:
                page, size = columns["page"][i].as_py(), columns["chars"][i].as_py()
            else:
                blocks = columns["html"][i].as_py() or ""
                page, size = _number(blocks), len(blocks)
            if rows and rows[-1][2] == page:
                rows.append((columns["page_id"][i].as_py(), columns["url"][i].as_py(), page, 0, None))
                continue
            if chars >= 2 * GROUP_CHARS:  # the rest is never less than a stretch
                first, head = 0, 0
                while first < len(rows) and (head < GROUP_CHARS or rows[first][4] is None):
                    head += rows[first][3]
                    first += 1
                cut = True
                yield taken(rows[:first], False)
                rows, chars = rows[first:], chars - head
            chars += size
            rows.append((columns["page_id"][i].as_py(), columns["url"][i].as_py(), page, size, columns["blocks"][i].as_py() if "blocks" in names else blocks))
    if rows:
        yield taken(rows, not cut)


def _told(tell: Callable[[Stretch, np.ndarray], tuple[np.ndarray, np.ndarray]], meeting: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each stretch of a host of several tells the others: its keys and the pages of each, one row for each range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _stretches(batches):
            if not rows.alone:
                keys, pages = tell(rows.stretch, rows.keys)
                ranges = -(-rows.parts // meeting)
                cuts = [0, *np.searchsorted(keys, np.array([(k << 64) // ranges - (1 << 63) for k in range(1, ranges)], np.int64)).tolist(), len(keys)]
                told = [(k, _packed(keys[a:b]), zlib.compress(pages[a:b].tobytes(), 1)) for k, (a, b) in enumerate(pairwise(cuts)) if a < b]
                columns = [pa.array([rows.host] * len(told), pa.string()), pa.array([rows.part] * len(told), pa.int64()), *(pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary())))]
                yield pa.record_batch(columns, names=["host", "part", "range", "keys", "pages"])

    return run


def _shared(told: pa.Table) -> pa.Table:
    """Of one range of keys of a host, for each stretch those of its keys that are on two pages at least, but for those of which it knows that."""
    each = [_unpacked(k) for k in told.column("keys").to_pylist()]
    pages = np.concatenate([np.frombuffer(zlib.decompress(p), np.uint8) for p in told.column("pages").to_pylist()])
    at = np.unique(np.concatenate(each), return_inverse=True)[1]
    shared = (np.bincount(at, pages) >= 2)[at] & (pages < 2)
    ends = np.cumsum([len(k) for k in each])[:-1]
    lists = [_packed(k[s]) if s.any() else None for k, s in zip(each, np.split(shared, ends), strict=True)]
    out = told.select(["host", "part"]).append_column("keys", pa.array(lists, pa.binary()))
    return out.filter(pc.is_valid(out.column("keys")))


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main texts of rows that come sorted by host and part."""
    for batch in batches:
        kind = batch.column("page_id").type
        for rows in _stretches(chain([batch], batches)):
            by_page = rows.stretch.found(rows.keys)
            found = [by_page[p] for p in rows.pages]
            columns = [rows.ids, rows.urls, [f.text for f in found], [len(f.text) for f in found], [f.tokens for f in found], [f.covered for f in found]]
            kinds = (kind, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "text", "n_chars", "n_tokens", "n_repeated"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_tokens, n_repeated) of every row: its main text, blocks in page order joined by a newline.

    Of a page with an article (``article`` or ``main``) the article's blocks, without furniture in it; of
    another the open blocks, without those that at least half is covered by substrings of LEAST tokens on
    distinct pages of the host. A page nearly all of whose open text is on other pages is a copy and keeps
    its open blocks; equal pages count once. n_tokens and n_repeated: all tokens of the page (words and a
    mark for each block) and those that repeats cover. text has decoded character references and is empty
    where nothing is left; null and empty pages are empty; null urls and such without :// share one host;
    rows repeat as they come; an empty table gives no rows; other columns of any name are ignored. Pages
    are taken whole, however long.

    Pages are dealt by host, those of a host of over GROUP_CHARS characters (and over one in LARGE_HOSTS of
    all) in parts of about so many, and each stretch of GROUP_CHARS at least has its own suffix array. What
    stretches of a host share is exchanged in two steps. Each tells the least anchor of its windows of LEAST
    tokens, so none that two stretches hold is missed; then the windows under anchors that are in several, by
    keys of 64 bits with the number of pages that have them. So the result is that of all pages of a host in
    one array. Equal pages have one part by their text, where they are counted, and further copies are dealt
    to others; keys are sent as packed arrays, one a stretch and range of keys.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(host_of(url).alias("host"), F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    sizes = cut_lineage(rows.groupBy("host").agg(F.sum(F.coalesce(F.char_length("html"), F.lit(0)) + 1).alias("chars")))
    unit = max(GROUP_CHARS, (sizes.agg(F.sum("chars")).first()[0] or 0) // LARGE_HOSTS)
    large = sizes.where(F.col("chars") > unit).select("host", F.ceil(F.col("chars") / unit).alias("parts"))
    read = rows.mapInArrow(_read, f"host string, page_id {kind}, url string, page long, again boolean, chars long, blocks binary")
    # of each batch of rows one copy goes to the part that its text names, so none is only elsewhere
    several = F.coalesce("parts", F.lit(1).cast("long"))
    part = F.pmod(F.when(F.col("again"), F.xxhash64("page_id", "url", F.monotonically_increasing_id())).otherwise(F.col("page")), several).alias("part")
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = read.join(F.broadcast(large), "host", "left").select("host", part, several.alias("parts"), "page_id", "url", "page", "chars", "blocks").repartition(parts, "host", "part")
    order = ("host", "part", "page", "page_id", "url")
    at = dealt.withColumn("at", F.row_number().over(Window.partitionBy("host", "part").orderBy(*order[2:])))

    def with_keys(keys: DataFrame) -> DataFrame:
        """The rows, the first of each part with its keys."""
        lists = keys.select(F.col("host").alias("_host"), F.col("part").alias("_part"), "keys").repartition(parts, "_host", "_part").groupBy("_host", "_part").agg(F.collect_list("keys").alias("keys"))
        return at.join(lists, (F.col("host") == F.col("_host")) & (F.col("part") == F.col("_part")) & (F.col("at") == 1), "left").drop("_host", "_part").sortWithinPartitions("host", "part", "at")

    def shared(rows: DataFrame, tell: Callable[[Stretch, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        told = rows.mapInArrow(_told(tell, max(1, MEETING * GROUP_CHARS // unit)), "host string, part long, range long, keys binary, pages binary")
        return told.groupBy("host", "range").applyInArrow(_shared, "host string, part long, keys binary")

    def anchors_of(stretch: Stretch, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = _changing(stretch.anchors)
        return keys, np.ones(len(keys), np.uint8)

    anchors = shared(dealt.sortWithinPartitions(*order), anchors_of)
    windows = shared(with_keys(anchors), Stretch.distinct)
    schema = f"page_id {kind}, url string, text string, n_chars long, n_tokens long, n_repeated long"
    return with_keys(windows).mapInArrow(_by_host, schema).withColumnRenamed("page_id", id_col)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
