"""Packing of documents into sequences of a fixed capacity by harmonic classes.

A length r belongs to class k when capacity/(k+1) < r <= capacity/k; a bin of class k
holds exactly k pieces. Every worker fills the bins of each class on its own, so the
main pass needs no exchange at all. A rest that would waste more than ``slack`` of its
class's slot is cut so that its first part fills the slot of the next class entirely.
What open bins hold when a worker ends (at most k - 1 pieces a class) goes, as rows
without ids, through a second harmonic pass over groups of workers, whose own open
bins are then filled by first fit on descending length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import prepare, Scratch, text_rows, trimmed
from driftline.llm.tokens import encode_rows

CAPACITY = 4096
#: Share of a class's slot that a piece may leave empty before it is cut instead.
SLACK = 0.03
#: Workers whose open bins are packed together; with the capacity it bounds the rows of one task.
GROUP = 64
#: Bytes of text encoded at once: executors come to this stage of the pipeline with the memory of the others still held.
SLICE_BYTES = 2_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_group int"


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids, in order: whole bins, then its rest by classes."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= slack * slot or rest <= capacity // 64:
            out.append(rest)
            break
        part = capacity // (k + 1)
        out.append(part)
        rest -= part
    return out


class OpenBins:
    """One open bin for each class; ``add`` gives back a bin's pieces once it holds its k."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, {}

    def add(self, length: int, piece: tuple) -> list[tuple[int, tuple]] | None:
        k = self.capacity // length
        bin_ = self.held.setdefault(k, [])
        bin_.append((length, piece))
        return self.held.pop(k) if len(bin_) == k else None

    def rest(self) -> list[tuple[int, tuple]]:
        return [x for k in sorted(self.held) for x in self.held[k]]


def _laid(pieces: list[tuple[int, tuple]], sequence: int) -> Iterator[tuple]:
    at = 0
    for length, piece in pieces:
        yield (*piece, sequence, at, None)
        at += length


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.int32()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """One row per piece: where its ids start in the document, their crc32, and its place in a sequence.

    Null and empty texts have the end id alone and are packed like any other. Repeated rows
    and repeated ids are packed each on its own. An empty table gives an empty result. Other
    columns of the input are not read. Sequences are padded to ``capacity`` by the reader.
    """
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        bins, sequence = OpenBins(capacity), worker << 36
        for part, ids, ends in encode_rows(batches, vocabulary, end_id, SLICE_BYTES):
            out = []
            raw = ids.astype("<u4", copy=False)
            for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                at = a
                for length in cuts(b - a, capacity, slack):
                    piece = (doc, at - a, length, zlib.crc32(raw[at : at + length]), b - a)
                    at += length
                    if full := bins.add(length, piece):
                        out.extend(_laid(full, sequence))
                        sequence += 1
            yield _batch(out)
        yield _batch([(*piece, None, None, worker // GROUP) for _, piece in bins.rest()])

    def second_pass(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        rows = [(p[2], p) for p in zip(*columns, strict=True)]
        rows.sort(key=lambda x: (-x[0], x[1][0] is not None, x[1][0] or 0, x[1][1], x[1][3]))
        bins, sequence, out = OpenBins(capacity), -1 - (key[0].as_py() << 36), []
        for length, piece in rows:
            if full := bins.add(length, piece):
                out.extend(_laid(full, sequence))
                sequence -= 1
        for laid in first_fit(sorted(bins.rest(), key=lambda x: -x[0]), capacity):
            out.extend(_laid(laid, sequence))
            sequence -= 1
        return pa.Table.from_batches([_batch(out)])

    first = scratch.write(text_rows(df, id_col, text_col).mapInArrow(trimmed(first_pass), PIECES), "first")
    full = first.filter("sequence_id IS NOT NULL")
    rest = first.filter("sequence_id IS NULL").groupBy("bin_group").applyInArrow(second_pass, PIECES)
    return full.unionByName(rest).drop("bin_group")


def first_fit(pieces: list[tuple[int, tuple]], capacity: int) -> list[list[tuple[int, tuple]]]:
    """Bins of pieces given by descending length; each piece goes to the first bin with room.

    A tree over the rooms finds that bin in logarithmic time.
    """
    leaves = 1
    while leaves < max(1, len(pieces)):
        leaves *= 2
    room = np.full(2 * leaves, capacity, np.int64)
    bins: list[list[tuple[int, tuple]]] = []
    for length, piece in pieces:
        node = 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= length else 2 * node + 1
        if (at := node - leaves) == len(bins):
            bins.append([])
        bins[at].append((length, piece))
        room[node] -= length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def padding(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, ids and padded share of a packing; a sequence whose length is a power of two takes no padding."""
    sizes = df.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.expr("bit_count(n) = 1")
    return sizes.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("ids"), (1 - F.sum("n") / F.sum(F.when(exact, F.col("n")).otherwise(capacity))).alias("padded")
    )
