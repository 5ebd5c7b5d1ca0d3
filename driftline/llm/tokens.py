"""Token ids from the public word-level tokenizer file, each distinct word of a slice encoded once.

The vocabulary's pre-tokenizer never matches across white space, and its normalizer
neither composes nor reorders across it, so a text's ids are the ids of its ASCII
white-space separated words one after another. A word of Latin letters and the ASCII
punctuation behind it are two pre-tokens, so these are encoded apart as well. All ids
come from the tokenizer itself; texts are assembled from its answers.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at once, so that memory follows this and not the batch; a longer text is a slice of its own.
SLICE_BYTES = 8_000_000
#: Words given to the tokenizer as one text, separated by blanks, and words at once (its answers are large objects).
TOGETHER, AT_ONCE = 50, 20_000
#: Words of letters whose ids a worker keeps from slice to slice: with their ids some 10 MB.
KEPT_WORDS = 200_000
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "^[a-zÀ-ÖØ-öø-ÿ]+$"

_encoders: dict[str, WordEncoder] = {}


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or starts.max() < 2**31) else np.int64
    ends -= lengths
    out = np.repeat(starts.astype(kind) - ends.astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def _behind(words: pa.Array, bases: pa.Array) -> pa.Array:
    """What is left of each word behind its beginning, taken from the words' bytes at once."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    cut = pc.binary_length(bases).to_numpy(zero_copy_only=False).astype(np.int32)
    if not len(words):
        return pa.array([], pa.string())
    starts = np.frombuffer(words.buffers()[1], np.int32, len(words), words.offset * 4)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[_ragged(starts + cut, size - cut)]
    ends = np.concatenate([[0], np.cumsum(size - cut)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


class WordEncoder:
    """Ids of texts as one flat array and offsets; ``vocabulary`` is the path of a tokenizers file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.kept, self.kept_ids, self.kept_lengths = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters: many in one text, taken apart at the ids that end a word."""
        ids, _ = self._ids([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)])
        ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._ids(words)
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _all(self, some: pa.Array, how=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has, some at once."""
        got = [(how or self._ids)(some.slice(i, AT_ONCE).to_pylist()) for i in range(0, len(some), AT_ONCE)]
        return np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in got]]), np.concatenate([np.zeros(0, np.int32), *[n for _, n in got]])

    def _kept(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of letters: those of earlier slices as they were, the others from the tokenizer."""
        at = pc.index_in(words, value_set=self.kept)
        new = words.filter(pc.is_null(at))
        ids, n = self._all(new, self._words)
        pool, lengths = np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_lengths, n])
        which = pc.fill_null(at, -1).to_numpy()
        which = np.where(which < 0, len(self.kept) - 1 + np.cumsum(which < 0), which)
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32)
        if more := min(KEPT_WORDS - len(self.kept), len(new)):
            self.kept = pa.concat_arrays([self.kept, new.slice(0, more)])
            self.kept_lengths = lengths[: len(self.kept)].copy()
            self.kept_ids = pool[: int(self.kept_lengths.sum())].copy()
        return pool[_ragged(starts[which], lengths[which])], lengths[which]

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of distinct words."""
        base = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        plain = pc.match_substring_regex(base, _LETTERS)
        mask = plain.to_numpy(zero_copy_only=False)
        letters = base.filter(plain).dictionary_encode()
        tails = _behind(words.filter(plain), base.filter(plain)).dictionary_encode()
        pieces, lengths = [], []
        for some, how in ((letters.dictionary, self._kept), (tails.dictionary, self._all), (words.filter(pc.invert(plain)), self._all)):
            ids, n = how(some)
            pieces.append(ids)
            lengths.append(n)
        pool, lengths = np.concatenate([np.zeros(0, np.uint32), *pieces]), np.concatenate([*lengths, np.zeros(1, np.int32)])
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32)
        n_letters, n_tails = len(letters.dictionary), len(tails.dictionary)
        part = np.full((len(words), 2), len(lengths) - 1, np.int32)
        part[mask, 0] = np.asarray(letters.indices)
        part[mask, 1] = n_letters + np.asarray(tails.indices)
        part[~mask, 0] = n_letters + n_tails + np.arange(int((~mask).sum()))
        part = part.ravel()
        return pool[_ragged(starts[part], lengths[part])], lengths[part].reshape(-1, 2).sum(axis=1, dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text with a final end). Null texts are empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        bounds = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        pool, lengths = self._parts(coded.dictionary)
        which = np.asarray(coded.indices)
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32)
        sizes, first = lengths[which], starts[which]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[bounds - bounds[0]]
        del split, coded, which
        return pool[_ragged(first, sizes)], ends


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts hold about ``most`` bytes; a longer text is a range of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts hold about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each slice (of about ``most`` bytes) of batches with ``text``: the slice, all ids with ``end_id`` after each text, and offsets."""
    coder = encoder(vocabulary)
    for batch in gathered(batches, "text", most):
        for part in slices(batch, "text", most):
            ids, ends = coder.encode(part.column("text"))
            n = part.num_rows
            shifted = ends + np.arange(n + 1)
            out = np.full(int(shifted[-1]), end_id, np.uint32)
            own = np.ones(len(out), bool)
            own[shifted[1:] - 1] = False
            out[own] = ids
            del own, ids
            yield part, out, shifted
