"""Main text of web pages, with boilerplate found as substrings that a host repeats.

A page is cut into blocks. What stands in an ``article`` or ``main`` element is content;
what stands in menus, footers and the like is chrome. A page without such an element has
open blocks, and these are judged by its host: all pages' token streams (chrome and open
blocks; a substring ends with its block) form a suffix array, cut at ``LENGTH`` tokens: the
rank of a suffix comes from prefix doubling over token hashes, so equal ranks are equal
beginnings. A beginning that suffixes of ``PAGES`` distinct pages share is a repeated
substring. A longer repeated substring covers just what its pieces of ``LENGTH`` tokens
cover, so the array need not be deeper; a whole block on so many pages is repeated however
short it is. Covered tokens of open blocks go, and
the runs between them stay, but for scraps in a block that is mostly covered.

Content is judged by the array as well, but there only a substring that stands in the content of
more than ``COMMON`` of the host's pages, and of its distinct ones, is repeated: texts quote
each other, and what ``PAGES`` pages share may be their text. A substring on such a share of all
pages is on such a share of some group of them, so a worker names those of its groups, and
only these are counted.

The array is never in one place: suffixes meet by (host, rank) in an aggregation that
combines before it shuffles, so a host of any size spreads over all tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import prepare, Scratch, small, trimmed
from driftline.llm.shingles import mix, text_bytes, word_hashes
from driftline.llm.tokens import slices

#: Tokens of a substring that counts as long (a power of two), distinct pages that must share it; in a block of which
#: this share is covered, a run of fewer tokens than this is a scrap.
LENGTH, PAGES, COVERED, SCRAP = 8, 3, 0.6, 4
SLICE_BYTES = 8_000_000
#: Share of the pages of a host with content beyond which what they share there is no text of theirs, and least distinct pages; ranks of a group.
COMMON, COMMON_PAGES, GROUP_RANKS = 0.75, 8, 2_000_000
#: Substrings on more pages than this find their pages by a broadcast.
HOT_PAGES = 1_000
#: Elements by role (fixed values).
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "object", "xmp", "noembed", "noframes"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "label", "input", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in a class, id or role that mark chrome (fixed values).
CHROME_WORDS = set(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay paywall popup promo promoted promotion related replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that mark chrome only outside an article, where they may be part of it.
HEAD_WORDS = {"header", "complementary", "contentinfo", "alert"}
#: Words that mark nothing inside an article when they stand alone, and words that say nothing in a compound of chrome words.
VAGUE = {"notice", "notification", "search", "social"}
PARTS = set(
    "area article articles bar block body bottom box button buttons col column container content form global icon icons inner item items left link links list main outer page panel post posts primary right row secondary section site slot stories text top unit wrap wrapper".split()
)
#: Words of readers' comments: an ``article`` so marked, or in an element so marked, is none of the page's own.
COMMENT_WORDS = {"comment", "comments", "replies", "reply", "disqus"}
#: Elements whose id names a part of the article.
_NAMED = {"section", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that need no end: their next sibling, or the end of what holds them, ends them.
_ITEMS, _LISTS = {"li", "td", "th", "dt", "dd"}, {"ul", "ol", "menu", "table", "tr", "dl"}


def _compounds(value: str, words: set[str]) -> bool:
    """Whether a whole token of the value is one of the words, or a compound of them and of words that say nothing."""
    for token in value.split():
        parts = set(_WORDS.findall(token))
        if parts & words and parts <= words | CHROME_WORDS | HEAD_WORDS | PARTS:
            return True
    return False


def _comments(attributes: str) -> bool:
    return any(key.lower() in ("class", "id") and _compounds((a or b or c).lower(), COMMENT_WORDS) for key, a, b, c in _ATTRIBUTE.findall(attributes))


def _marks_chrome(name: str, attributes: str, inside: bool) -> bool:
    if name in CHROME or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = (a or b or c).lower(), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none", value):
                return True
            continue
        if inside and key != "role":
            if not (key == "id" and name in _NAMED) and _compounds(value, CHROME_WORDS - VAGUE):
                return True
            continue
        if _compounds(value, CHROME_WORDS if inside else CHROME_WORDS | HEAD_WORDS):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of each block in page order: ``main``, ``chrome`` or ``open``; never an empty text.

    Character references are decoded, white space is one blank, ends are trimmed. Elements
    that are never closed end where the next of their kind must begin, or with the page; an
    article ends chrome that was left open, but not readers' comments.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    at, end, inside = 0, len(page), 0
    skip, depth, comments = "", 0, False

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(("chrome" if skip else "main" if inside else "open", text))

    while at < end:
        start = page.find("<", at)
        if start < 0:
            held.append(page[at:])
            break
        if start > at:
            held.append(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        tag = _TAG.match(page, start) or _LOOSE.match(page, start)
        if tag is None:
            if page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/":
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                held.append("<")
                at = start + 1
            continue
        at = tag.end()
        shut, name, attributes = tag[1] == "/", tag[2].lower(), tag[3]
        if name in RAW and not shut:
            if not attributes.endswith("/"):
                found = _END[name].search(page, at)
                stop = page.find(">", found.start()) if found else -1
                at = end if stop < 0 else stop + 1
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            close()
        if skip and name in ("article", "main") and not shut and not (comments and name == "article"):
            close()
            skip, depth = "", 0
        if skip:
            own = name == skip
            if (skip == "p" and name in BLOCKS) or (skip in _ITEMS and ((own and not shut) or (shut and name in _LISTS))):
                close()
                skip, depth = "", 0
                if own and shut:
                    continue
            else:
                depth += 0 if not own else -1 if shut else 1
                if depth <= 0:
                    close()
                    skip, depth = "", 0
                continue
        if name == "article" and not shut and _comments(attributes):
            close()
            skip, depth, comments = name, 1, True
        elif name in ("article", "main"):
            inside = max(0, inside + (-1 if shut else 1))
        elif not shut and name not in VOID and not attributes.endswith("/") and _marks_chrome(name, attributes, inside > 0):
            close()
            skip, depth, comments = name, 1, _comments(attributes)
    close()
    return out


def ranks(tokens: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each suffix by its first ``length`` tokens, by prefix doubling."""
    rank, width = tokens, 1
    while width < length and len(rank) > width:
        rank = mix(rank[:-width] + mix(rank[width:] + np.uint64(width)))
        width *= 2
    return rank if width == length else np.zeros(0, np.uint64)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw, ends = text_bytes(pa.array(texts, pa.string()))
    return word_hashes(raw, ends)


_WHOLE = np.uint64(0x5DEECE66D)


def wholes(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each whole block; other than any rank of a substring."""
    each = [mix(tokens[a:b] + np.arange(b - a, dtype=np.uint64)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return np.array([np.bitwise_xor.reduce(x, initial=_WHOLE + np.uint64(len(x))) for x in each], np.uint64)


def beginnings(blocks_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where suffixes of a stream of blocks begin that have ``LENGTH`` tokens of their block, their ranks, hashes of whole blocks)."""
    tokens, ends = _tokens(blocks_)
    rank = ranks(tokens)
    own = np.repeat(np.arange(len(blocks_)), np.diff(ends))
    at = np.flatnonzero(own[: len(rank)] == own[len(tokens) - len(rank) :])
    return at, rank[at], wholes(tokens, ends)


def content_ranks(text: str) -> np.ndarray:
    """The distinct ranks and hashes of whole blocks of a content."""
    return np.unique(np.concatenate(beginnings(text.split("\n"))[1:]))


class Group:
    """Contents of pages by host: which ranks a large share of a host's pages in this group has."""

    def __init__(self):
        self.hosts: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, host: str, text: str) -> None:
        ranks_ = content_ranks(text)
        self.hosts.setdefault(host, []).append(ranks_)
        self.held += len(ranks_)

    def common(self) -> tuple[list[str], list[np.ndarray]]:
        names, found = [], []
        for host, pages in self.hosts.items():
            rank, n = np.unique(np.concatenate(pages), return_counts=True)
            if (n > COMMON * len(pages)).any():
                names.append(host)
                found.append(rank[n > COMMON * len(pages)].view(np.int64))
        self.hosts, self.held = {}, 0
        return names, found


def parse(html_text: str) -> tuple[list[str], list[str], np.ndarray]:
    """(content blocks, open blocks, ranks and hashes of the whole stream outside the content)."""
    found = blocks(html_text)
    main = [t for role, t in found if role == "main"]
    open_ = [] if main else [t for role, t in found if role == "open"]
    return main, open_, np.concatenate(beginnings([t for role, t in found if role != "main"])[1:])


def kept(open_blocks: list[str], repeated: np.ndarray) -> list[str]:
    """What repeated substrings and repeated whole blocks leave of open blocks."""
    words = [b.split() for b in open_blocks]
    ends = np.cumsum([0, *map(len, words)])
    at, rank, whole = beginnings(open_blocks)
    hit = at[np.isin(rank, repeated)]
    cover = np.zeros(int(ends[-1]) + 1, np.int64)
    cover[hit] += 1
    cover[hit + LENGTH] -= 1
    covered = np.cumsum(cover) > 0
    gone, out = np.isin(whole, repeated), []
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        own = covered[a:b]
        if gone[k]:
            continue
        if not own.any():
            out.append(open_blocks[k])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], own.astype(np.int8), [1]])))
        least = SCRAP if own.mean() >= COVERED else 1
        out += [" ".join(words[k][i:j]) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if j - i >= least]
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (blocks joined by line feeds) and ``n_chars`` (code points) of every page.

    Null and empty html have an empty text, and so has a page all of whose blocks are
    boilerplate. A line that most pages of a host have in their content goes from it. Pages with one and the same stream are one page as evidence. A null url
    is a host of its own. Repeated rows give a row each; an empty table gives an empty
    result; other columns are not read.
    """
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()), ("open", pa.list_(pa.string())), ("ranks", pa.list_(pa.int64())), ("stream", pa.int64()), ("common", pa.list_(pa.int64()))])
    schema = "page_id long, url string, host string, text string, open array<string>, ranks array<long>, stream long, common array<long>"

    def named(group: Group) -> pa.RecordBatch:
        """Rows without a page: what is common to a host's pages in a group."""
        hosts, found = group.common()
        columns = [pa.array(found if f.name == "common" else hosts if f.name == "host" else [None] * len(hosts), f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, arrow.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group()
        for batch in batches:
            for part in slices(batch, "html", SLICE_BYTES):
                text, open_, all_, stream = [], [], [], []
                for page, of in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True):
                    main, rest, ranks_ = parse(page)
                    text.append("\n".join(main))
                    if main:
                        group.add(of, text[-1])
                    open_.append(rest)
                    all_.append(np.unique(ranks_).view(np.int64))
                    stream.append(int(np.bitwise_xor.reduce(mix(ranks_ + np.arange(len(ranks_), dtype=np.uint64)), initial=np.uint64(len(ranks_))).astype(np.int64)))
                made = [pa.array(x, arrow.field(c).type) for x, c in ((text, "text"), (open_, "open"), (all_, "ranks"), (stream, "stream"), ([None] * len(text), "common"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *made], arrow.names)
                if group.held > GROUP_RANKS:
                    yield named(group)
        yield named(group)

    written = scratch.write(rows.mapInArrow(trimmed(cut), schema), "parsed").withColumn("row", F.monotonically_increasing_id())
    parsed, groups = written.filter("common IS NULL"), written.filter("common IS NOT NULL")
    array = parsed.select("host", "stream", F.explode("ranks").alias("rank")).groupBy("host", "rank").agg(F.count_distinct("stream").alias("pages"))
    repeated = scratch.write(array.filter(F.col("pages") >= PAGES), "repeated")
    asked = parsed.filter(F.size("open") > 0)
    own, key = asked.select("row", "host", F.explode("ranks").alias("rank")), ["host", "rank"]
    hot = small(repeated.filter(F.col("pages") > HOT_PAGES).select(*key))
    hits = own.join(hot, key, "left_semi").unionByName(own.join(hot, key, "left_anti").join(repeated.select(*key), key, "left_semi"))
    hits = hits.groupBy("row").agg(F.collect_set("rank").alias("repeated"))  # within one page
    judged = asked.join(hits, "row", "left").select("page_id", "url", "open", F.coalesce("repeated", F.array().cast("array<long>")).alias("repeated"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("open", "repeated"))
            text = ["\n".join(kept(b, np.array(r, np.int64).view(np.uint64))) for b, r in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    result = "page_id long, url string, text string"
    done = parsed.filter(F.size("open") == 0)
    if (lines := _common_lines(done.filter("text <> ''"), groups, scratch)) is not None:
        mixed = done.join(lines, "row").select("page_id", "url", F.split("text", "\n").alias("open"), "repeated")
        done = done.join(lines, "row", "left_anti").select("page_id", "url", "text").unionByName(mixed.mapInArrow(keep, result))
    done = done.select("page_id", "url", "text").unionByName(judged.mapInArrow(keep, result))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def _common_lines(pages: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame | None:
    """For each page (``row host text``) with such the ranks that are common to its host's pages, as ``row`` and ``repeated``."""
    key = ["host", "rank"]
    sizes = pages.groupBy("host").agg(F.count("*").alias("all"), F.count_distinct(F.xxhash64("text")).alias("apart")).filter(F.col("apart") >= COMMON_PAGES)
    maybe = scratch.write(groups.select("host", F.explode("common").alias("rank")).distinct().join(sizes, "host"), "maybe")
    if maybe.isEmpty():
        return None

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = [content_ranks(x).view(np.int64) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "host", "page")], pa.array(found, pa.list_(pa.int64()))], ["row", "host", "page", "ranks"])

    asked = pages.join(small(maybe.select("host").distinct()), "host", "left_semi").select("row", "host", F.xxhash64("text").alias("page"), "text")
    runs = asked.mapInArrow(trimmed(ranked), "row long, host string, page long, ranks array<long>").select("row", "host", "page", F.explode("ranks").alias("rank"))
    held = scratch.write(runs.join(small(maybe.select(*key)), key, "left_semi"), "held")
    counts = held.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("page").alias("d")).join(maybe, key)
    common = scratch.write(counts.filter((F.col("n") > COMMON * F.col("all")) & (F.col("d") > COMMON * F.col("apart")) & (F.col("d") >= COMMON_PAGES)).select(*key), "common")
    return scratch.write(held.join(small(common), key, "left_semi").groupBy("row").agg(F.collect_set("rank").alias("repeated")), "lines")
