"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, under a softmax.

The vectors and the output layer are learnt together by stochastic gradient descent in
numpy, in one task over a bounded sample of labelled texts, which comes to it as buckets
and their shares (a text has at most as many as there are buckets). As the output is linear in
the average, a trained model keeps for every bucket what its vector adds to the margin
between the classes, and scoring a text is one lookup for each word and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import prepare, text_rows, trimmed
from driftline.llm.shingles import _BYTE, SLICE_BYTES, _power, mix
from driftline.llm.tokens import slices
from driftline.llm.toxicity import held_out, labelled

#: Most labelled rows that training reads, buckets of the hash (as bits), size of a vector, passes and step.
TRAIN_ROWS, BITS, WIDTH, EPOCHS, STEP = 6_000, 18, 16, 5, 0.5
#: Character n-grams, in bytes; they may begin or end with one white-space character, which marks a word's edge.
GRAMS = (3, 4)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bucket of the pair of a word with itself, whatever the word: an average of single vectors can't tell such runs.
_AGAIN = 1


def buckets(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Buckets of all words, of words that repeat the word before, and of the n-grams of each length, each with the text it belongs to."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[0])) if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    space = _SPACE[raw]
    raw = np.where(space, np.uint8(32), raw)
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    out, of = [], []
    shift = np.uint64(64 - BITS)
    inside = ~space
    edge = np.zeros(size + 1, bool)
    edge[ends] = True
    if size:
        starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], space[:-1]])))
        stops = np.flatnonzero(inside & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
        words = _word_hash(raw, starts, stops)
        out.append((words >> shift).astype(np.int32))
        of.append(text[starts])
        again = np.flatnonzero((words[1:] == words[:-1]) & (text[starts[1:]] == text[starts[:-1]])) + 1
        out.append(np.full(len(again), _AGAIN, np.int32))
        of.append(text[starts[again]])
    for g in GRAMS:
        if size < g:
            continue
        last = size - g + 1
        key = np.full(last, g, np.uint64)
        for k in range(g):
            key = (key << np.uint64(8)) | raw[k : last + k].astype(np.uint64)
        whole = text[:last] == text[g - 1 :]
        for k in range(1, g - 1):
            whole &= inside[k : last + k]
        whole &= inside[:last] | inside[g - 1 :]
        at = np.flatnonzero(whole)
        out.append((mix(key[at]) >> shift).astype(np.int32))
        of.append(text[at])
    return out, of, n


def _word_hash(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + np.uint64(0xA5A5))


def shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text, and the share of each."""
    out, of, n = buckets(texts)
    flat, text = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (out, of))
    key, count = np.unique((text.astype(np.int64) << BITS) | flat, return_counts=True)
    at = np.searchsorted(key >> BITS, np.arange(n + 1))
    return [((key[i:j] & ((1 << BITS) - 1)).astype(np.int32), (count[i:j] / max(1, count[i:j].sum())).astype(np.float32)) for i, j in zip(at[:-1], at[1:], strict=True)]


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """What each bucket adds to the margin, and the margin of an empty text."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, WIDTH), dtype=np.float32) - 0.5) / WIDTH).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.log(np.array([1 - y.mean(), y.mean()]) + 1e-3).astype(np.float32)
    steps, total = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)).tolist():
            step = STEP * (1 - steps / total)
            steps += 1
            which, share = rows[i]
            hidden = share @ vectors[which]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = p @ output
            output -= step * np.outer(p, hidden)
            bias -= 0.1 * step * p
            if len(which):
                vectors[which] -= (step / (share @ share) * share)[:, None] * back  # the average moves by the step, however uneven the shares
    side = output[1] - output[0]
    return vectors @ side, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str, keep) -> tuple[np.ndarray, float]:
    """The model over at most ``TRAIN_ROWS`` labelled rows for which ``keep`` holds; without labels of both kinds a constant."""
    prepare(docs.sparkSession)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        y = (table.column("y").to_numpy() > 0).astype(np.float64)
        if len(set(y.tolist())) < 2:
            rate = float(y.mean()) if len(y) else 0.0
            gain, base = np.zeros(1 << BITS, np.float32), 30.0 if rate > 0.5 else -30.0
        else:
            pairs = zip(table.column("which"), table.column("share"), strict=True)
            gain, base = train([(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(b.as_buffer(), "<f4")) for a, b in pairs], y)
        return pa.table({"gain": pa.array([gain.astype(np.float32).tobytes()], pa.binary()), "base": pa.array([base])})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                which, share = zip(*shares(part.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([x.tobytes() for x in which], pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())], ["doc_id", "y", "which", "share"])

    rows = labelled(docs, labels, label, keep, TRAIN_ROWS).select("doc_id", "text", F.col("y").cast("double").alias("y"))
    rows = rows.mapInArrow(trimmed(describe), "doc_id long, y double, which binary, share binary")
    model = rows.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "gain binary, base double").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), -30.0
    return np.frombuffer(bytes(model["gain"]), np.float32), model["base"]


def margins(texts: pa.Array, gain: np.ndarray, base: float) -> np.ndarray:
    out, of, n = buckets(texts)
    total, count = np.zeros(n), np.zeros(n, np.int64)
    for which, text in zip(out, of, strict=True):
        if len(which):
            at = np.searchsorted(text, np.arange(n + 1))
            total += np.diff(np.concatenate([[0.0], np.cumsum(gain[which], dtype=np.float64)])[at])
            count += np.diff(at)
    return base + total / np.maximum(count, 1)


def score(df: DataFrame, gain: np.ndarray, base: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row, from its whole text."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                z = margins(part.column("text"), shared.value, base)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return text_rows(df, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, score double")


def quality(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    Labels of held-out rows are never read. Null and empty texts get the score of the
    bias alone; without labels of both kinds all scores are the one kind's (0 without
    any). An empty table gives an empty result; other columns are not read.
    """
    gain, base = fit(text_rows(documents, "doc_id", "text"), labels, "quality", ~held_out("doc_id", folds, fold))
    return score(documents, gain, base).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
