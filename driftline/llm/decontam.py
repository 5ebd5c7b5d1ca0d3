"""Benchmark passages in documents, within an edit budget.

Benchmark items are cut into overlapping windows of two sizes: large ones, and small ones
at steps no larger than their edit budget, so that any part of an item as long as a small
window holds one within its budget, wherever the part starts. A window of m bytes that occurs in a
text with at most k edits shares at least ``m - q + 1 - k q`` q-grams with it, all on
diagonals at most k apart. So: mark every position of a text whose q-gram is in any
item; count q-grams by item and by overlapping bands of diagonals, and keep the bands
that reach the least bound of the item's windows; there, count them by window and band
in the same way, and keep the bands that reach the window's own bound; align those
windows with a banded dynamic programme. Texts are compared with case folded by Unicode and
every run of ASCII white space as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, prepare, row_key, text_rows, trimmed, without
from driftline.llm.shingles import mix
from driftline.llm.tokens import slices

#: Bytes of a large window (the whole item, if shorter) and between windows, share of its bytes that may be edited, length of a q-gram.
WINDOW, STRIDE, EDITS, Q = 96, 32, 0.1, 8
#: The same of small windows, for quotes of a part of an item; the stride is at most the budget.
PART, PART_STRIDE = 48, 4
#: Shortest item that is looked for within an edit budget; shorter ones are looked for as they are, at word boundaries.
SHORTEST = 32
#: Bytes of benchmark in one pass over the documents; a larger benchmark takes more passes.
PASS_BYTES = 4_000_000
#: Bytes of texts at a time; small, since a position that is marked is held once for each window over it.
SLICE_BYTES = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_BITS = 20
#: Bytes of words: ASCII letters, digits and _, and code points beyond ASCII by their first byte (not those of scripts without blanks, nor signs).
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(0xC3, 0xE2), *range(0xEA, 0xEE)]] = True


#: What case folding makes of a code point beyond ASCII, where it changes it; the code points it changes, as a table.
_FOLD = {c: np.frombuffer(chr(c).casefold().encode(), np.uint8) for c in range(128, 0x1F000) if chr(c).casefold() != chr(c)}
_FOLDS = np.zeros(0x200000, bool)
_FOLDS[list(_FOLD)] = True


def _cased(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(bytes with code points beyond ASCII folded, original position of each byte; None if no length changes)."""
    at = np.flatnonzero(raw >= 0xC3)
    if not len(at):
        return raw, None
    lead = raw[at].astype(np.int64)
    more = (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    code = lead & np.array([0x1F, 0x0F, 0x07])[more]
    for k in range(1, 4):
        code = np.where(k <= more + 1, code << 6 | raw[np.minimum(at + k, len(raw) - 1)] & 0x3F, code)
    hit = _FOLDS[code]
    at, code, size = at[hit], code[hit], more[hit] + 2
    if not len(at):
        return raw, None
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    groups = [(_FOLD[c], at[g], int(size[g[0]])) for c, g in zip(codes.tolist(), np.split(order, first[1:]), strict=True)]
    if all(len(new) == n for new, _, n in groups):
        out, origin, starts = raw.copy(), None, None
    else:
        count = np.ones(len(raw), np.int64)
        for new, where, n in groups:
            count[where] = len(new) - n + 1 if len(new) >= n else 1
            for k in range(len(new), n):
                count[where + k] = 0
        origin = np.repeat(np.arange(len(raw)), count)
        out, starts = raw[origin], np.cumsum(count) - count
    for new, where, _ in groups:
        for k, byte in enumerate(new):
            out[(where if starts is None else starts[where]) + k] = byte
    return out, origin


def folded(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with case folded and one blank for each run of white space, offsets, original position of each byte)."""
    raw, origin = _cased(raw)
    if origin is not None:
        ends = np.searchsorted(origin, ends)
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    keep = ~space | first[:-1] | np.concatenate([[True], ~space[:-1]])
    at = np.flatnonzero(keep)
    return _LOWER[raw[at]], np.searchsorted(at, ends), at if origin is None else origin[at]


def grams(text: np.ndarray) -> np.ndarray:
    """The q-gram at each position, packed into a number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    last = len(text) - Q + 1
    key = text[:last].astype(np.uint64)
    for k in range(1, Q):
        key = (key << np.uint64(8)) | text[k : last + k]
    return key


@dataclass
class Grid:
    """Windows of like size, an item's one after another at steps of a stride, the last at its end.

    Bands of diagonals are a step apart and two steps wide, a step is at least the largest budget.
    """

    stride: int
    step: int
    first: np.ndarray  # by item: its first window
    count: np.ndarray
    last: np.ndarray  # by item: where its last window begins
    width: np.ndarray

    def over(self, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows over the q-gram at each place of an item, how many over each)."""
        low = np.maximum(-((self.width[item] - Q - place) // self.stride), 0)
        high = np.where(place >= self.last[item], self.count[item], np.minimum(place // self.stride + 1, self.count[item]))
        runs = np.maximum(high - low, 0)
        return np.arange(runs.sum()) + np.repeat(self.first[item] + low - (np.cumsum(runs) - runs), runs), runs


@dataclass
class Windows:
    """Windows of some items; the q-grams of the items, sorted, with the places where they stand."""

    item: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    text: np.ndarray  # bytes of all items in a row
    at: np.ndarray  # by window: where it begins there
    keys: np.ndarray
    starts: np.ndarray
    of_item: np.ndarray  # by place of a q-gram: its item, where it stands there
    place: np.ndarray
    least: np.ndarray  # by item: the least bound of its windows
    grids: list[Grid]
    marks: np.ndarray
    short: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # length of a beginning, sorted beginnings, starts, windows

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Windows:
        texts = []
        for _, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            texts.append(np.frombuffer(folded(raw, np.array([0, len(raw)]))[0].tobytes().strip(), np.uint8))
        long = np.array([len(t) for t in texts], np.int64)
        offset = np.cumsum(long) - long
        flat = np.concatenate([np.zeros(0, np.uint8), *texts, np.zeros(WINDOW, np.uint8)])
        item, begin, size, shapes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for width, stride, some in ((WINDOW, STRIDE, long > 0), (PART, PART_STRIDE, long > PART)):
            last = np.maximum(long - width, 0)
            count = np.where(some, -(-last // stride) + 1, 0)
            of = np.repeat(np.arange(len(items)), count)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            shapes.append((stride, sum(map(len, item)) + np.cumsum(count) - count, count, last, np.minimum(long, width)))
            item.append(of)
            begin.append(np.minimum(nth * stride, last[of]))
            size.append(np.minimum(long[of], width))
        item, begin, size = np.concatenate(item), np.concatenate(begin), np.concatenate(size)
        budget = np.where(size < SHORTEST, 0, np.minimum((size * EDITS).astype(np.int64), np.maximum((size - Q) // Q, 0)))
        bound = size - Q + 1 - budget * Q
        own = np.flatnonzero(long >= SHORTEST)
        key = np.concatenate([np.zeros(0, np.uint64), *(grams(texts[i]) for i in own)])
        grams_of = long[own] - Q + 1
        order = np.argsort(key, kind="stable")
        of_item = np.repeat(own, grams_of)[order].astype(np.int32)
        place = (np.arange(len(key)) - np.repeat(np.cumsum(grams_of) - grams_of, grams_of))[order].astype(np.int32)
        keys, starts = np.unique(key[order], return_index=True)
        marks = np.zeros(1 << _BITS, bool)
        marks[(mix(keys) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        least = np.full(len(items), 1 << 40)
        wide = size >= SHORTEST
        np.minimum.at(least, item[wide], bound[wide])
        grids = [Grid(stride, max(int(budget[wide & (size <= width)].max(initial=0)), 1), first, count, last, width_) for width, (stride, first, count, last, width_) in zip((WINDOW, PART), shapes, strict=True)]
        short = []
        for n in range(1, Q + 1):
            own = np.flatnonzero((size < SHORTEST) & (np.minimum(size, Q) == n))
            if len(own):
                beginning = grams(flat[(offset[item[own]] + begin[own])[:, None] + np.arange(Q)].ravel())[::Q] >> np.uint64(8 * (Q - n))
                order = np.argsort(beginning, kind="stable")
                short_keys, short_starts = np.unique(beginning[order], return_index=True)
                short.append((n, short_keys, np.append(short_starts, len(own)), own[order]))
        return cls(item, begin, size, budget, bound, flat, offset[item] + begin, keys, np.append(starts, len(key)), of_item, place, least, grids, marks, short)

    def __len__(self) -> int:
        return len(self.size)


def exact(text: np.ndarray, ends: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows (text, window, 0), start, end) of every place of an item below ``SHORTEST``, at word boundaries."""
    rows, begin = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    if windows.short and len(text):
        padded = np.concatenate([text, np.zeros(SHORTEST, np.uint8)])
        lead = np.flatnonzero((padded & 0xC0) != 0x80)
        word = np.repeat(_WORD[padded[lead]], np.diff(np.append(lead, len(padded))))
        if lead[0]:
            word = np.concatenate([np.zeros(lead[0], bool), word])
        edge = np.ones(len(text) + 1, bool)
        edge[1:] = ~(word[: len(text)] & word[1 : len(text) + 1])
        edge[ends] = True
        key, at = grams(padded), np.flatnonzero(edge[:-1])
        for n, keys, starts, own in windows.short:
            mine = key[at] >> np.uint64(8 * (Q - n))
            found = np.searchsorted(keys, mine)
            found[found == len(keys)] = 0
            real = keys[found] == mine
            where, found = at[real], found[real]
            runs = starts[found + 1] - starts[found]
            window = own[np.arange(runs.sum()) + np.repeat(starts[found] - (np.cumsum(runs) - runs), runs)]
            where = np.repeat(where, runs)
            size, text_of = windows.size[window], np.searchsorted(ends, where, side="right") - 1
            stop = where + size
            good = stop <= ends[text_of + 1]
            good[good] = edge[stop[good]]
            for k in range(SHORTEST - 1):
                good &= (k >= size) | (padded[where + np.minimum(k, size)] == windows.text[windows.at[window] + np.minimum(k, size)])
            rows.append(np.stack([text_of, window, np.zeros_like(window)], axis=1)[good])
            begin.append(where[good])
    out, start = np.concatenate(rows), np.concatenate(begin)
    return out, start, start + windows.size[out[:, 1]]


def _runs(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each entry of the runs that are asked for, length of each run)."""
    runs = starts[which + 1] - starts[which]
    return np.arange(runs.sum()) + np.repeat(starts[which] - (np.cumsum(runs) - runs), runs), runs


def _bands(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct cells, rows in each one and the next, which of them each row is in). A band is a cell and the next one."""
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(cell) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    cells, counts = ranked[at], np.diff(np.append(at, len(cell)))
    which = np.empty(len(cell), np.int64)
    which[order] = np.cumsum(new) - 1
    total = counts.copy()
    total[:-1] += np.where(cells[1:] == cells[:-1] + 1, counts[1:], 0)
    return cells, total, which


def candidates(text: np.ndarray, ends: np.ndarray, windows: Windows) -> Iterator[tuple[np.ndarray, int]]:
    """Rows (text, window, lowest diagonal of the band) of bands that reach their window's bound, and the step of the bands."""
    key = grams(text)
    if not len(key) or not len(windows.keys):
        return
    at = np.flatnonzero(windows.marks[(mix(key) >> np.uint64(64 - _BITS)).astype(np.int64)])
    found = np.searchsorted(windows.keys, key[at])
    found[found == len(windows.keys)] = 0
    real = windows.keys[found] == key[at]
    at, found = at[real], found[real]
    own = np.searchsorted(ends, at, side="right") - 1
    real = at + Q <= ends[own + 1]
    at, found, own = at[real], found[real], own[real]
    entry, runs = _runs(windows.starts, found)
    at, own, item = np.repeat(at, runs), np.repeat(own, runs), windows.of_item[entry]
    step, longest = max(grid.step for grid in windows.grids), int(windows.place.max()) + Q
    bands = (len(text) + longest) // step + 3
    cells, total, which = _bands((own * len(windows.least) + item) * bands + (at - windows.place[entry] + longest) // step + 1)
    full = total >= windows.least[cells // bands % len(windows.least)]
    # a band that begins in the cell before holds this cell's rows too
    full |= np.concatenate([[False], full[:-1] & (cells[1:] == cells[:-1] + 1)])
    keep = full[which]
    at, own, item, place = at[keep], own[keep], item[keep], windows.place[entry[keep]].astype(np.int64)
    for grid in windows.grids:
        window, runs = grid.over(item, place)
        if not len(window):
            continue
        diagonal = np.repeat(at - place, runs) + windows.begin[window]
        bands = (len(text) + WINDOW) // grid.step + 3
        cells, total, _ = _bands((np.repeat(own, runs) * len(windows) + window) * bands + (diagonal + WINDOW) // grid.step + 1)
        rows = np.stack([cells // bands // len(windows), cells // bands % len(windows), (cells % bands - 1) * grid.step - WINDOW], axis=1)
        yield rows[total >= windows.bound[rows[:, 1]]], grid.step


def align(text: np.ndarray, ends: np.ndarray, rows: np.ndarray, windows: Windows, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best alignment of each row's window near its band; the text's ends are free.

    All rows advance together, one byte of their windows at a time; a row that is over its
    budget in every cell is left behind. A cell holds edits and the start it came from, so
    the smallest cell is the fewest edits, then the first start.
    """
    big = 1 << 29
    budget, size = windows.budget[rows[:, 1]], windows.size[rows[:, 1]]
    reach = int(budget.max(initial=0))
    width = 2 * step + 2 * reach + 1
    low = rows[:, 2] - reach
    lo, hi = ends[rows[:, 0]], ends[rows[:, 0] + 1]
    offset = np.arange(width, dtype=np.int32)
    best = np.full((len(rows), width), big, np.int32)
    one, span = 1 << 10, np.arange(int(size.max(initial=0)))
    slope = offset[None, :] * np.int32(one)
    live = np.arange(len(rows))
    first = low[:, None] + offset[None, :]
    cell = np.where((first >= lo[:, None]) & (first <= hi[:, None]), offset[None, :], np.int32(big))
    for i in range(int(size.max(initial=0))):
        if i % 8 == 0:
            stay = (cell.min(axis=1, initial=big) >> 10 <= budget[live]) & (size[live] > i)
            live, cell, first = live[stay], cell[stay], first[stay]
            from_, to = lo[live, None], hi[live, None]
            pattern = windows.text[windows.at[rows[live, 1], None] + span]
        place = first + i
        ok = (place >= from_) & (place < to)
        same = text[np.clip(place, 0, max(len(text) - 1, 0))] == pattern[:, i : i + 1]
        straight = np.where(ok, cell + np.where(same, np.int32(0), np.int32(one)), np.int32(big))
        skipped = np.concatenate([cell[:, 1:], np.full((len(live), 1), big, np.int32)], axis=1) + np.int32(one)
        cell = np.minimum(straight, skipped)
        cell = np.minimum.accumulate(cell - slope, axis=1) + slope
        cell = np.where((place + 1 >= from_) & (place + 1 <= to), cell, np.int32(big))
        done = size[live] == i + 1
        best[live[done]] = cell[done]
    pick = best.argmin(axis=1)
    value = best[np.arange(len(rows)), pick].astype(np.int64)
    return value >> 10, low + (value & 1023), low + pick + size


def matches(texts: pa.Array, windows: Windows) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, windows found, start, end, fewest edits) with code points of the text as it came."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    text, ends, at = folded(raw, bounds)
    rows, start, stop = exact(text, ends, windows)
    parts = [(rows, np.zeros(len(rows), np.int64), start, stop)]
    for rows, step in candidates(text, ends, windows):
        edits, start, stop = align(text, ends, rows, windows, step)
        good = edits <= windows.budget[rows[:, 1]]
        parts.append((rows[good], edits[good], start[good], stop[good]))
    rows, edits, start, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(rows):
        return
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    from_, to = points[at[start]], points[at[np.maximum(stop - 1, start)] + 1]
    found: dict[tuple[int, int], list] = {}
    for t, w, a, b, e in zip(rows[:, 0].tolist(), rows[:, 1].tolist(), from_.tolist(), to.tolist(), edits.tolist(), strict=True):
        base = int(points[bounds[t]])
        seen = found.setdefault((t, int(windows.item[w])), [set(), a - base, b - base, e])
        seen[0].add(w)
        seen[1], seen[2], seen[3] = min(seen[1], a - base), max(seen[2], b - base), min(seen[3], e)
    for (t, item), (which, a, b, e) in sorted(found.items()):
        yield t, item, len(which), a, b, e


SCHEMA = "doc_id long, item_id long, n_matched long, n_windows long, start long, stop long, edits long"


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item of which at least one window is found.

    ``n_matched`` of the item's ``n_windows``, the span from the first to the last of them
    in code points of the text, and the fewest edits of one. Null or empty texts hold
    nothing; null or empty items are not looked for, and items shorter than ``SHORTEST``
    folded bytes only without edits, between word boundaries; equal texts and ids give a row each. An empty table on either side gives an empty
    result. The benchmark goes to the workers in parts of bounded size, one pass each.
    """
    spark = df.sparkSession
    prepare(spark)
    rows, out = text_rows(df, id_col, text_col), None
    for part in _parts(text_rows(benchmark, item_col, item_text, "item_id")):
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast((part, Windows.of(part)))), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _parts(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size > PASS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, windows = shared.value
        n_windows = np.bincount(windows.item, minlength=len(items))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                docs = part.column("doc_id").to_pylist()
                out = [(docs[t], items[item][0], n, int(n_windows[item]), a, b, e) for t, item, n, a, b, e in matches(part.column("text"), windows)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return trimmed(run)


def keep_unleaked(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a benchmark passage, with all their columns; an id with one takes all its rows along.

    A row without an id is judged by its own text.
    """
    rows = df.select(row_key().alias("doc_id"), "text")
    return without(df, Scratch(df.sparkSession, "decontam").write(leaks(rows, benchmark).select("doc_id").distinct(), "gone"))
