"""HTML extraction: suffix arrays of hosts' token streams find repeated substrings, page structure checks the rest.

A page's stream holds the tokens of all its blocks but those that its structure protects (inside ``article`` or
``main``), with a mark between blocks. Streams are put together by the chunk, tokens of different hosts being
different, and each chunk's suffix array is built by prefix doubling. Suffixes with ``LEAST`` tokens in common are
neighbours there; one row for each such run of neighbours, with its least and largest page, leaves the task,
so that a substring of a third of all pages is a few rows when runs of all chunks meet. Runs of two distinct
pages are boilerplate, short blocks that are equal as a whole too. Where structure settles a block, its verdict
then stands: menus, headers, footers, sidebars, notices, adverts, forms and comments go although they are unique,
text of the article stays although it is repeated. Everywhere else (pages without such a container or with
several, doubtful class names inside one) covered tokens go and unique runs stay.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .textstream import mix, word_hashes

#: Tokens of a substring that counts as long.
LEAST = 12
#: Tokens of a chunk whose suffixes are sorted together.
CHUNK_TOKENS = 1 << 20
#: Element names and words of class, id and role attributes.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea button title head".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_WORDS = frozenset("nav navbar navigation menu sidebar masthead ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent popup modal newsletter subscribe signup login comment comments reply replies disqus share sharing social recommended breadcrumb breadcrumbs widget toolbar pagination pager".split())
#: Words that also name parts of an article: alone they are doubtful.
DOUBTFUL_WORDS = frozenset("header footer notice notices alert discussion related copyright legal".split())
RELATED = frozenset("posts articles links stories news content items topics reading".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Without backtracking, so that a page of unclosed tags or quotes costs no more than others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+>", re.S)
_OPEN_END = re.compile(r"<[a-zA-Z/!]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _chrome(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element is outside the main text, by its name and attributes: 1 yes, 2 perhaps, 0 no."""
    if name in CHROME or (name == "header" and not in_main):
        return 1
    doubtful = 0
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 1
        if key == "role" and value.lower() in CHROME_ROLES:
            return 1
        if key in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & CHROME_WORDS or ("related" in words and (len(words) == 1 or words & RELATED)):
                return int(name not in ("html", "body", "article", "main") or bool(re.search(r"comment|repl", value, re.I)))
            if words & DOUBTFUL_WORDS and name not in ("html", "body", "article", "main"):
                doubtful = 2
    return doubtful


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(standing, text) of each non-empty block in page order; 1 main, 2 main but doubtful, 0 unknown, -1 outside. Broken nesting is read leniently: an end tag closes up to its start, a new article closes open menus and the like."""
    # A tag or comment that the page's end leaves open is none of its text.
    end = page.rfind(">") + 1
    if m := _OPEN_END.search(page, end):
        page = page[: m.start()]
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # element, standing inside it
    standing, at, skip, containers = 0, 0, None, 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((standing, text))

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if skip is None:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if skip is not None:
            if m[1] and name == skip:
                skip = None
            continue
        if name in HIDDEN:
            if not m[1] and not (m[3] or "").endswith("/") and name != "embed":
                if name in ("script", "style", "textarea", "title"):  # raw text up to the end tag
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    skip = name
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCK and name not in ("span", "a", "label", "section"):
            continue
        if name in BLOCK:
            flush()
        if name in VOID or name in ("a", "label", "p"):
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name == "span":
                        held.append("")
                    del stack[k:]
                    standing = stack[-1][1] if stack else 0
                    break
            continue
        if name == "span":
            if _chrome(name, m[3] or "", True) != 1:
                continue
            flush()
        commented = any(s == -2 for _, s in stack)
        chrome = _chrome(name, m[3] or "", standing in (1, 2))
        if chrome == 1:
            inside = -2 if commented or re.search(r"comment|repl|disqus", m[3] or "", re.I) else -1
        elif commented:
            inside = -2
        elif chrome == 2 and standing >= 0:
            inside = 2 if standing else 0
        elif name in ("article", "main") or re.search(r"role\s*=\s*[\"']?main", m[3] or "", re.I):
            while stack and stack[-1][1] == -1:
                stack.pop()
            containers += standing not in (1, 2)
            inside = 1
        else:
            inside = standing
        stack.append((name, inside))
        standing = inside
    if skip is None:
        held.append(page[at:])
    flush()
    # A page with one container names its text; what stands outside of that is not of it.
    outside = -1 if containers == 1 and any(s > 0 for s, _ in out) else 0
    return [(outside if s == 0 else max(s, -1), t) for s, t in out]


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first tokens, number of tokens that each has in common with the one before it), both up to ``depth`` tokens, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while width < depth:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:]
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    for level, ranks in zip(range(len(levels) - 1, -1, -1), reversed(levels), strict=True):
        a, b = order[:-1] + common[1:], order[1:] + common[1:]
        inside = (a < n) & (b < n)
        # Two suffixes of one rank have all its tokens, as those that end sooner have ranks of their own.
        common[1:] += (inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])) << level
    return order, np.minimum(common, depth)


class Streams:
    """Token streams of pages, one behind the other: a mark before and behind each block, a break where protected text or another page lies between."""

    MARK = np.uint64(1)

    def __init__(self, pages: list[tuple[int, str, list[tuple[int, str]]]]):
        """pages: (hash of the page, host, blocks)."""
        texts = [t.encode("utf-8", "surrogatepass") for _, _, blocks in pages for s, t in blocks if s != 1]
        words, count = word_hashes(texts, lower=False) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        salts = np.array([int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest(), "little") for _, host, _ in pages], np.uint64)
        mark = mix(self.MARK ^ salts) | np.uint64(1)
        parts, starts, owner, at, k, done = [], [], [], 0, 0, 0
        self.first = []  # place of each page's stream
        for no, (_, _, blocks) in enumerate(pages):
            self.first.append(at)
            broken = True
            for standing, _ in blocks:
                if standing == 1:
                    broken = True
                    continue
                if broken:  # breaks are even numbers, each its own; tokens and marks are odd
                    parts.append(np.array([2 * at, mark[no]], np.uint64))
                    at += 2
                n = int(count[k])
                starts.append(at)
                owner.append(no)
                parts += [mix(words[done : done + n] ^ salts[no]) | np.uint64(1), mark[no : no + 1]]
                at, k, done, broken = at + n + 1, k + 1, done + n, False
        self.starts, self.sizes, self.owner = np.array(starts, np.int64), np.array(count, np.int64), np.array(owner, np.int64)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.pages = np.array([h for h, _, _ in pages], np.int64)
        #: Page of each place.
        self.page = np.searchsorted(np.array(self.first, np.int64), np.arange(at), "right") - 1

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places at which ``least`` tokens without a break begin, their hashes)."""
        n = len(self.tokens) - least + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        breaks = np.concatenate(([0], np.cumsum(self.tokens & np.uint64(1) == 0)))
        whole = np.flatnonzero(breaks[least:] == breaks[:n])
        step = mix(np.arange(201, 201 + least, dtype=np.uint64)) | np.uint64(1)
        hashed = np.zeros(len(whole), np.uint64)
        for k in range(least):
            hashed += self.tokens[whole + k] * step[k]
        return whole, mix(hashed)

    def blocks(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of blocks shorter than ``least`` tokens, hashes of their tokens)."""
        short = np.flatnonzero((self.sizes < least) & (self.sizes > 0))
        hashed = np.zeros(len(short), np.uint64)
        for k in range(least - 1):
            own = self.sizes[short] > k
            hashed[own] = mix(hashed[own] * np.uint64(31) + self.tokens[self.starts[short[own]] + k])
        return short, mix(hashed + self.sizes[short].astype(np.uint64))

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, least page, largest page) of each run of neighbours in the suffix array that have ``least`` tokens in common, and of each short block."""
        out = []
        whole, hashed = self.windows(least)
        if len(whole):
            order, common = suffix_array(self.tokens, least)
            place = np.full(len(self.tokens), -1)
            place[whole] = np.arange(len(whole))
            run = np.cumsum(common < least)[place[order] >= 0]
            order = order[place[order] >= 0]
            first = np.flatnonzero(np.diff(run, prepend=-1))
            pages = self.pages[self.page[order]]
            out.append((hashed[place[order[first]]], np.minimum.reduceat(pages, first), np.maximum.reduceat(pages, first)))
        short, hashed = self.blocks(least)
        if len(short):
            order = np.argsort(hashed, kind="stable")
            first = np.flatnonzero(np.diff(hashed[order].view(np.int64), prepend=~hashed[order[:1]].view(np.int64)))
            pages = self.pages[self.owner[short[order]]]
            out.append((hashed[order[first]], np.minimum.reduceat(pages, first), np.maximum.reduceat(pages, first)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([o[k] for o in out]).view(np.int64) for k in range(3))


_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")


def host_of(url: str | None) -> str:
    """The authority of a url in lower case, empty without."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def undecided(blocks: list[tuple[int, str]]) -> bool:
    return any(s in (0, 2) for s, _ in blocks)


def _found(least: int, every: bool):
    """Rows (page_id, url, h, html) -> runs (kind 0) and pages that structure does not settle, or ``every`` page (kind 1)."""

    def run(batches):
        held, size = [], 0

        def flush():
            seed, low, high = Streams(held).runs(least)
            n = len(seed)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(seed), pa.array(low), pa.array(high), *none], _NAMES)

        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for page_id, url, h, page in zip(*[batch.column(c) for c in ("page_id", "url", "h", "html")], strict=True):
                blocks, key = blocks_of(page.as_py() or ""), h.as_py()
                held.append((key, host_of(url.as_py()), blocks))
                size += sum(t.count(" ") + 2 for s, t in blocks if s != 1)
                if every or undecided(blocks):
                    for column, value in zip(rows, (page_id.as_py(), url.as_py(), key, [s for s, _ in blocks], [t for _, t in blocks]), strict=True):
                        column.append(value)
                if size > CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
            n = len(rows[0])
            none = [pa.nulls(n, pa.int64())] * 3
            columns = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *none, *columns], _NAMES)
        yield flush()

    return run


_NAMES = ["kind", "seed", "low", "high", "page_id", "url", "h", "standings", "texts"]
_FOUND = "kind int, seed long, low long, high long, page_id long, url string, h long, standings array<int>, texts array<string>"


def _read(batch: pa.RecordBatch) -> list[tuple[int, str, list[tuple[int, str]]]]:
    return [(h, host_of(url), list(zip(s, t, strict=True))) for h, url, s, t in zip(*[batch.column(c).to_pylist() for c in ("h", "url", "standings", "texts")], strict=True)]


def _seeds(least: int):
    """Pages -> (h, host, seed, at, n): the long substrings of each page's own stream, and its short blocks."""

    def run(batches):
        for batch in batches:
            for page in _read(batch):
                s = Streams([page])
                whole, hashed = s.windows(least)
                short, own = s.blocks(least)
                at, n = np.concatenate((whole, s.starts[short])), np.concatenate((np.full(len(whole), least), s.sizes[short]))
                seed = np.concatenate((hashed, own)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), page[0])), pa.array([page[1]] * len(at), pa.string()), pa.array(seed), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "host", "seed", "at", "n"])

    return run


def _cover(page: tuple, covered: list[tuple[int, int]], least: int) -> list[tuple[int, str, np.ndarray]]:
    """(standing, text, covered or not by token) of each block. Where a run of several blocks ends within one, so few as under ``least`` tokens of it are no boilerplate."""
    s = Streams([page])
    hit = np.zeros(len(s.tokens) + 1, np.int64)
    for at, n in covered:
        hit[at] += 1
        hit[at + n] -= 1
    hit, k, out = np.cumsum(hit) > 0, 0, []
    for standing, text in page[2]:
        if standing == 1:
            out.append((standing, text, np.zeros(0, bool)))
        else:
            gone = hit[s.starts[k] : s.starts[k] + s.sizes[k]].copy()
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
            for a, b in zip(edge[0::2], edge[1::2], strict=True):
                if b - a < min(least, len(gone)):
                    gone[a:b] = False
            out.append((standing, text, gone))
            k += 1
    return out


def _assembled(least: int):
    def run(batches):
        for batch in batches:
            texts = []
            for page, covered in zip(_read(batch), batch.column("covered").to_pylist(), strict=True):
                kept = []
                for standing, text, gone in _cover(page, [(c["at"], c["n"]) for c in covered or ()], least):
                    if standing in (0, 2) and gone.any():
                        text = " ".join(w for w, g in zip(_TOKEN.findall(text), gone, strict=True) if not g)
                    if standing >= 0 and text:
                        kept.append(text)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


#: Tokens as ``word_hashes`` has them.
_TOKEN = re.compile(r"[^ \t-\r]+")


def _settled(batches):
    """The text of pages whose structure settles every block."""
    for batch in batches:
        pages = [blocks_of(page.as_py() or "") for page in batch.column("html")]
        sure = pa.array([not undecided(blocks) for blocks in pages], pa.bool_())
        text = pa.array(["\n".join(t for s, t in blocks if s == 1) for blocks in pages], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], ["page_id", "url", "text"]).filter(sure)


def _covered(found: DataFrame, least: int) -> DataFrame:
    """(h, host, covered) of the pages in ``found``: the parts of their streams that two distinct pages of the host have."""
    repeated = found.where("kind = 0").groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    once = found.where("kind = 1").select("url", "h", "standings", "texts").dropDuplicates(["h", "url"])
    own = once.mapInArrow(_seeds(least), "h long, host string, seed long, at int, n int").distinct()
    # The second key keeps the join from reusing the aggregate's layout, so AQE may split the commonest substrings.
    second = F.shiftright("seed", 7).alias("second")
    hit = own.select("*", second).join(repeated.select("seed", second), ["seed", "second"], "left_semi")
    return hit.groupBy("h", "host").agg(F.collect_list(F.struct("at", "n")).alias("covered"))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"), "html")


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def extract(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages and pages without text give an empty text. A substring counts as repeated if
    two pages of its host (the authority of the url; null urls share one) with different html have it, so
    copies of a whole page count as one. Repeated rows come back alike; other columns are ignored.
    """
    work, rows = Scratch(spark, "html"), _keyed(pages)
    found = work.save(rows.mapInArrow(_found(least, False), _FOUND), "found")
    # The second key of the join again lets AQE split a page with very many rows.
    tag = F.shiftright("h", 7).alias("tag")
    covered = _covered(found, least).select("h", tag, "host", "covered")
    open_ = found.where("kind = 1").select("page_id", "url", "h", tag, _host("url").alias("host"), "standings", "texts").join(covered, ["h", "tag", "host"], "left")
    open_ = open_.select("page_id", "url", "h", "standings", "texts", "covered").mapInArrow(_assembled(least), "page_id long, url string, text string")
    sure = rows.select("page_id", "url", "html").mapInArrow(_settled, "page_id long, url string, text string")
    return sure.union(open_).withColumn("n_chars", F.length("text").cast("long"))


def decisions(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(standing, covered, n_blocks, n_tokens): how many blocks of each standing the substring step covers whole, in part or not (yes, part, no)."""
    work = Scratch(spark, "html")
    found = work.save(_keyed(pages).mapInArrow(_found(least, True), _FOUND), "found")
    covered = _covered(found, least)
    rows = found.where("kind = 1").select("url", "h", _host("url").alias("host"), "standings", "texts").join(covered, ["h", "host"], "left")

    def counted(batches):
        for batch in batches:
            out = [(s, "no" if not gone.any() else "yes" if gone.all() else "part", len(_TOKEN.findall(t))) for page, c in zip(_read(batch), batch.column("covered").to_pylist(), strict=True) for s, t, gone in _cover(page, [(x["at"], x["n"]) for x in c or ()], least)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["standing", "covered", "n"])

    return rows.select("url", "h", "standings", "texts", "covered").mapInArrow(counted, "standing int, covered string, n long").groupBy("standing", "covered").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_tokens"))
