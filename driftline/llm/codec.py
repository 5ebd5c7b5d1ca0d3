"""Token ids on disk: canonical length-limited Huffman codes from global counts.

A store is a folder with two Parquet tables that Spark commits: ``codebook`` (one row:
the code length of every id) and ``blobs``. A blob holds whole documents in ascending
order of their ids, as bytes of our own format::

    4s magic  u32 version  u32 symbols a block  u32 documents  u64 ids  u64 bits
    documents x i64 document ids    documents x u64 numbers of ids
    blocks x u64 bit offset of each block (the checkpoints)
    payload: codes, most significant bit first, padded with 8 zero bytes

Code lengths alone fix the codes (canonical order: length, then id). Blocks decode
independently from their checkpoints by one lookup an id; here all blocks of a blob
advance together.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import prepare, Scratch, text_rows, trimmed
from driftline.llm.tokens import encode_rows

MAGIC, VERSION, HEAD = b"DLHC", 1, struct.Struct("<4sIIIQQ")
#: Longest code in bits (longer only if the alphabet needs it) and symbols between checkpoints.
LIMIT, BLOCK = 16, 128
#: Ids of a blob and of a range of documents that one task writes.
BLOB_IDS, RANGE_IDS = 1 << 18, 1 << 22
NO_ID = np.iinfo(np.int64).min


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(merged) // 2
        both = np.concatenate([leaves, merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        kinds.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(kinds):
        chosen = int(leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in canonical order, as the low bits of a number."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    sizes = lengths[used].tolist()
    values = []
    for size in sizes:
        code <<= size - last
        values.append(code)
        code, last = code + 1, size
    codes[used] = np.array(values, np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every window of ``width`` bits, id * 32 + code length; and that width."""
    width = max(1, int(lengths.max(initial=1)))
    out = np.zeros(1 << width, np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (width - lengths[used].astype(np.int64))).astype(np.int64)
    entries = used.astype(np.uint64) * np.uint64(32) + lengths[used].astype(np.uint64)
    filled = np.repeat(entries, spans)
    out[: len(filled)] = filled
    return out, width


def to_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray, int]:
    """(payload, checkpoints, bits)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros((bits >> 6) + 2, np.uint64)
    if bits:
        value, word = codes[ids], at >> 6
        room = 64 - (at & 63) - size
        over = room < 0
        shifted = np.where(over, value >> np.maximum(-room, 0).astype(np.uint64), value << np.maximum(room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(shifted, first)
        words[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (bits + 7) // 8 + 8], at[::block].astype(np.uint64), bits


def from_bits(payload: bytes, checkpoints: np.ndarray, count: int, table: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """All ids; every block advances from its own checkpoint."""
    if not count:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8).astype(np.uint32)
    window = np.zeros(len(raw), np.uint32)
    window[:-3] = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((block, len(at)), np.uint32)
    last = count - (len(at) - 1) * block
    shift, mask = 32 - width, np.uint32((1 << width) - 1)
    table = table.astype(np.uint32)
    for i in range(block):
        if i == last:
            at = at[:-1]
        if not len(at):
            break
        entry = table[(window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask]
        out[i, : len(at)] = entry >> 5
        at = at + (entry & 31)
    return out.T.ravel()[:count]


def to_blob(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    payload, checkpoints, bits = to_bits(ids, lengths, codes, block)
    return b"".join((HEAD.pack(MAGIC, VERSION, block, len(docs), len(ids), bits), docs.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), checkpoints.astype("<u8").tobytes(), payload))


def from_blob(blob: bytes, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, numbers of ids, all ids)."""
    magic, version, block, n, count, _ = HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a blob of this format")
    at = HEAD.size
    docs = np.frombuffer(blob, "<i8", n, at)
    sizes = np.frombuffer(blob, "<u8", n, at + 8 * n).astype(np.int64)
    blocks = -(-count // block)
    checkpoints = np.frombuffer(blob, "<u8", blocks, at + 16 * n)
    return docs, sizes, from_bits(blob[at + 16 * n + 8 * blocks :], checkpoints, count, table, width, block)


def write_store(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encode every text and write the store at ``path``.

    Texts are encoded once, into a scratch table of raw ids; the counts of all ids come
    from it by one combined aggregation (its result is bounded by the vocabulary), and
    its rows go by range of document id to the tasks that write. Null text: only the end
    id. Equal document ids lie side by side, by their ids, and may be dealt over several tasks; a null id comes first. An empty table gives
    a store without blobs.
    """
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "codec")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, ends in encode_rows(batches, vocabulary, end_id):
            raw = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
            data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((ends * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
            width = pa.array(np.full(part.num_rows, raw.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), data, width], ["doc_id", "ids", "width"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in _flat_ids(batch):
                found = np.bincount(ids)
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    tokens = scratch.write(text_rows(df, id_col, text_col).mapInArrow(trimmed(encode), "doc_id long, ids binary, width int"), "tokens")
    found = tokens.select("ids", "width").mapInArrow(trimmed(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    codes = canonical_codes(lengths)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, total = TaskContext.get().partitionId(), 0, [], 0

        def blob() -> pa.RecordBatch:
            docs = np.array([d if d is not None else NO_ID for d, _ in held], np.int64)
            sizes = np.array([len(x) for _, x in held], np.int64)
            data = to_blob(docs, sizes, np.concatenate([x for _, x in held]), lengths, codes)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "blob"])

        for batch in batches:
            for doc, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}")
                held.append((doc, ids))
                total += len(ids)
                if total >= BLOB_IDS:
                    yield blob()
                    seq, held, total = seq + 1, [], 0
        if held:
            yield blob()

    ranges = max(1, -(-int(counts.sum()) // RANGE_IDS))
    (
        tokens.repartitionByRange(ranges, "doc_id", F.substring("ids", 1, 16)).sortWithinPartitions("doc_id", "ids")
        .mapInArrow(trimmed(write), "part int, seq int, n_ids long, blob binary")
        .write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blobs")
    )
    scratch.drop()


def _flat_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    widths = np.asarray(batch.column("width"))
    data = batch.column("ids")
    for width in np.unique(widths):
        rows = data.filter(pa.array(widths == width)) if not (widths == width).all() else data
        bounds = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, rows.offset * 4)
        yield np.frombuffer(rows.buffers()[2], f"<u{width}", (int(bounds[-1]) - int(bounds[0])) // width, int(bounds[0]))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Decode a store: ``doc_id``, ``start`` (ids of all documents before it), ``ids``."""
    return _read(spark, path, "ids", "binary", lambda raw, a, b: raw[a:b].tobytes(), pa.binary())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Decode a store: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` over little-endian 32-bit ids."""
    return _read(spark, path, "ids_crc32", "long", lambda raw, a, b: zlib.crc32(raw[a:b]), pa.int64())


def _read(spark: SparkSession, path: str, name: str, kind: str, value, arrow_type) -> DataFrame:
    prepare(spark)
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decode_table(lengths)
        for batch in batches:
            for part, seq, blob in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("blob"), strict=True):
                docs, sizes, ids = from_blob(blob.as_py(), table, width)
                raw, ends = ids.astype("<u4"), np.cumsum(sizes)
                out = [value(raw, a, b) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NO_ID), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(ends - sizes), pa.array(sizes), pa.array(out, arrow_type)],
                    ["doc_id", "part", "seq", "inner", "n_tokens", name],
                )

    blobs = spark.read.schema("part int, seq int, n_ids long, blob binary").parquet(f"{path}/blobs")
    rows = blobs.select("part", "seq", "blob").mapInArrow(trimmed(decode), f"doc_id long, part int, seq int, inner long, n_tokens long, {name} {kind}")
    return rows.join(_bases(blobs), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", name)


def _bases(blobs: DataFrame) -> DataFrame:
    """Ids before each blob, by prefix sums on three levels: blobs of a range, ranges of a group, groups.

    Only the last runs in one task, over one row for each 4096 ranges (16 G ids).
    """
    size = blobs.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    part = size.groupBy("part").agg(F.sum("n").alias("n")).withColumn("band", F.expr("part div 4096"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    band = part.groupBy("band").agg(F.sum("n").alias("n")).withColumn("c", before(Window.orderBy("band"))).drop("n")
    part = part.withColumn("b", before(Window.partitionBy("band").orderBy("part"))).join(band, "band").select("part", (F.col("b") + F.col("c")).alias("b"))
    return size.withColumn("a", before(Window.partitionBy("part").orderBy("seq"))).join(part, "part").select("part", "seq", (F.col("a") + F.col("b")).alias("base"))
