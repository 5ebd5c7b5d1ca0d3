"""Packing and the id codec against plain recomputation."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftline.llm import codec, packing
from driftline.llm.queries import QUERIES, VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
SF = "/root/testdata/sf0.001"
ODD = [
    (0, None, "a", 1), (1, "", "b", 2), (2, "Hello, it's WORD's <|endoftext|>x́ ½ 漢字", "c", 3), (2, "same id", "d", 4),
    (3, "same text", "e", 5), (4, "same text", "f", 6), (5, "long words, " * 30_000, "g", 7), (None, "no id", "h", 8),
]


def odd(spark, rows=ODD):
    """Nulls, empty and very long texts, repeated ids, and extra columns whose names are those of results."""
    return spark.createDataFrame(rows, "doc_id long, text string, start string, sequence_id int")


def plain_ids(texts, end):
    coder = Tokenizer.from_file(PATH)
    return [np.array([*x.ids, end], "<u4") for x in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(rows, want):
    """want: list of (doc_id, ids)."""
    left = {}
    for doc, ids in want:
        left.setdefault(doc, []).append(ids)
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    assert set(by_doc) == set(left)
    for doc, parts in by_doc.items():
        found = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in parts)
        expected = []
        for ids in left[doc]:
            at = 0
            for length in packing.cuts(len(ids)):
                expected.append((at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)))
                at += length
            assert at == len(ids)
        assert found == sorted(expected)


def test_packs_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    result = QUERIES["op1_harmonic_packing"](spark, SF)
    check_packing(result.collect(), list(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs], 2), strict=True)))
    assert packing.padding(result).first().padded < 0.03


def test_packs_odd_rows(spark):
    rows = packing.pack(odd(spark), PATH).collect()
    check_packing(rows, list(zip([r[0] for r in ODD], plain_ids([r[1] for r in ODD], 2), strict=True)))
    assert packing.pack(odd(spark, []), PATH).count() == 0


@given(st.integers(1, 60_000))
def test_cuts_fill_slots(length):
    parts = packing.cuts(length)
    assert sum(parts) == length and max(parts) <= packing.CAPACITY and min(parts) > 0
    for p in parts:
        slot = packing.CAPACITY // (packing.CAPACITY // p)
        assert slot - p <= packing.SLACK * slot or p <= packing.CAPACITY // 64


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(1, 200))
def test_bits_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    counts = np.bincount(ids, minlength=301) if len(ids) else np.zeros(301, np.int64)
    lengths = codec.code_lengths(counts, 9)
    assert lengths.max(initial=0) <= 9 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    payload, checkpoints, _ = codec.to_bits(ids, lengths, codec.canonical_codes(lengths), block)
    table, width = codec.decode_table(lengths)
    assert (codec.from_bits(payload, checkpoints, len(ids), table, width, block) == ids).all()


def test_lengths_are_optimal_when_the_limit_is_loose():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((codec.code_lengths(counts, 30).astype(np.int64) * counts).sum()) == cost


def check_store(rows, want):
    want = sorted(want, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    at, expected = 0, []
    for doc, ids in want:
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == expected


def test_store_gives_back_every_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_store(QUERIES["op4_huffman_ids"](spark, SF).collect(), list(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs], 1), strict=True)))


@pytest.mark.parametrize("ranged", [1 << 22, 1000])
def test_store_of_odd_rows(spark, tmp_path, monkeypatch, ranged):
    monkeypatch.setattr(codec, "RANGE_IDS", ranged)
    monkeypatch.setattr(codec, "BLOB_IDS", 500)
    path = f"file://{tmp_path}/store"
    codec.write_store(odd(spark), path, PATH)
    check_store(codec.read_digests(spark, path).collect(), list(zip([r[0] for r in ODD], plain_ids([r[1] for r in ODD], 1), strict=True)))
    got = {(r.doc_id, bytes(r.ids)) for r in codec.read_store(spark, path).collect()}
    assert got == set(zip([r[0] for r in ODD], [x.tobytes() for x in plain_ids([r[1] for r in ODD], 1)], strict=True))


def test_store_of_nothing(spark, tmp_path):
    codec.write_store(odd(spark, []), f"file://{tmp_path}/store", PATH)
    assert codec.read_digests(spark, f"file://{tmp_path}/store").count() == 0


def test_words_are_encoded_once_for_all_slices(monkeypatch):
    """Ids are those of the tokenizer, whether a word was kept or not; kept words don't reach it again."""
    import pyarrow as pa

    from driftline.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    coder, asked = tokens.WordEncoder(PATH), []
    words = coder._words
    monkeypatch.setattr(coder, "_words", lambda some: (asked.extend(some), words(some))[1])
    for texts in (["one two, three", "two"], ["three four one", "", "Two five 6 six seven"], ["seven eight five one. two"], []):
        ids, ends = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(coder.kept) == 5 and all(asked.count(w) == 1 for w in coder.kept.to_pylist())
