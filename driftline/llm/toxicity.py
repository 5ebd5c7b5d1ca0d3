"""Toxicity by gradient-boosted trees over a few dense features, calibrated by isotonic regression.

The lexicon is learnt: words, and beginnings of words, by their log-odds among labelled
texts. Features are densities of lexicon words of two strengths, their nearness to words
of the second person, rates of capitals, punctuation and obfuscation, and plain shape.
Training features come from lexicons of the other folds, so that a text never helps to
choose the words it is then described by; calibration uses margins of other folds too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import prepare, row_key, Scratch, text_rows, trimmed, without
from driftline.llm.shingles import SLICE_BYTES, _power, mix
from driftline.llm.tokens import slices

#: Most labelled rows that training reads (chosen by hash of the id), folds, and terms of a lexicon.
TRAIN_ROWS, FOLDS, TERMS = 12_000, 4, 4096
#: Texts of a term before it can enter the lexicon, and log-odds of its two strengths.
SUPPORT, STRONG, WEAK = 4, 3.0, 1.5
#: Beginnings of words, in bytes.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
TREES, DEPTH, RATE, BINS, RIDGE, LEAF = 80, 3, 0.15, 64, 1.0, 4.0
#: Words of the second person (fixed values).
SECOND_PERSON = "you your yours yourself yourselves ya u ur du dich dir dein deine deiner ihr euch euer eure tu te toi ton tes vous votre vos tú usted ustedes vosotros vuestro tuyo ti".split()
NEAR = 5

_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 white space, 4 punctuation
_CLASS[97:123] = _CLASS[65:91] = 1
_CLASS[128:] = 1
_CLASS[[32, 9, 10, 11, 12, 13]] = 2
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[_a:_b] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Signs that stand for letters inside a word (fixed values).
_STANDS = np.zeros(256, np.uint8)
for _sign, _letter in zip("0134578@$!", "oieastbasi", strict=True):
    _STANDS[ord(_sign)] = ord(_letter)
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = 16


@dataclass
class Words:
    """Words of many texts: hashes of the word and its beginnings, each word's text, and counts by text."""

    terms: np.ndarray  # words x (1 + beginnings); 0 where a word is no longer than the beginning
    text: np.ndarray
    bounds: np.ndarray
    shape: np.ndarray  # texts x counts


def _hash(words: str) -> np.uint64:
    raw = np.frombuffer(words.encode(), np.uint8)
    up, _ = _power(len(raw))
    return mix(np.add.reduce(_BYTE[raw] * up[: len(raw)], keepdims=True))[0]


def words_of(texts: pa.Array) -> Words:
    """Words are runs of letters, lower-cased, once signs between letters that stand for letters are read as such."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[0])) if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[ends])
    kind = _CLASS[raw]
    letter = kind == 1
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
    stands = (_STANDS[raw] > 0) & before & after
    inner = (kind == 4) & before & after & ~stands & (raw != 39) & (raw != 45)
    upper = (raw >= 65) & (raw <= 90)
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    low = _LOWER[raw]
    low = np.where(stands, _STANDS[raw], low)
    low[1:] += np.where(upper[1:] & (raw[1:] >= 0x80), np.uint8(32), np.uint8(0))
    inside = letter | stands
    edge = np.zeros(size + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))) if size else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1 if size else np.zeros(0, np.int64)
    up, down = _power(max(1, size))
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:size], out=total[1:])
    terms = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.uint64)
    terms[:, 0] = mix((total[stops] - total[starts]) * down[starts])
    for k, length in enumerate(BEGINNINGS):
        long = stops - starts > length
        at = starts[long]
        terms[long, 1 + k] = mix((total[at + length] - total[at]) * down[at] + np.uint64(0x51ED270B + length))
    bounds = np.searchsorted(starts, ends)
    caps = np.concatenate([[0], np.cumsum(upper)])
    shout = (caps[stops] - caps[starts] >= 2) & ((caps[stops] - caps[starts]) * 10 >= (stops - starts) * 6)
    shouted = np.diff(np.concatenate([[0], np.cumsum(shout)])[bounds])
    chars = np.maximum(np.diff(ends), 1)
    n_words = np.maximum(np.diff(bounds), 1)
    shape = np.stack([count(upper) / np.maximum(count(letter), 1), shouted / n_words, count(kind == 4) / chars, count((raw == 33) | (raw == 63)) / chars, count(stands) / n_words, count(inner) / n_words, np.log1p(np.diff(bounds)), count(letter) / n_words], axis=1)
    return Words(terms, np.repeat(np.arange(n), np.diff(bounds)), bounds, shape)


class Lexicon:
    """Terms and their weights, found through a table indexed by some bits of the hash.

    Only the terms travel to workers; each makes the table (2 MB) when it first asks.
    """

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bits: int = 20):
        order = np.argsort(weights, kind="stable")
        self.bits, self.keys, self.weights, self.table = bits, hashes[order], weights[order].astype(np.float32), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def of(self, terms: np.ndarray) -> np.ndarray:
        """The greatest weight among each word's terms."""
        best = np.zeros(len(terms), np.float32)
        if not len(self.keys):
            return best
        shift = np.uint64(64 - self.bits)
        if self.table is None:
            self.table = np.full(1 << self.bits, -1, np.int16)
            self.table[(self.keys >> shift).astype(np.int64)] = np.arange(len(self.keys), dtype=np.int16)
        for k in range(terms.shape[1]):
            h = terms[:, k]
            at = self.table[(h >> shift).astype(np.int64)]
            hit = np.flatnonzero(at >= 0)
            hit = hit[self.keys[at[hit]] == h[hit]]
            best[hit] = np.maximum(best[hit], self.weights[at[hit]])
        return best


def features(words: Words, lexicon: Lexicon) -> np.ndarray:
    n = len(words.bounds) - 1
    weight = lexicon.of(words.terms)
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[words.bounds])
    count = np.maximum(np.diff(words.bounds), 1)
    strong, weak = weight >= STRONG, weight >= WEAK
    person = np.isin(words.terms[:, 0], np.array([_hash(w) for w in SECOND_PERSON], np.uint64))
    seen = np.concatenate([[0], np.cumsum(person)])
    hits = np.flatnonzero(weak)
    a, b = words.bounds[words.text[hits]], words.bounds[words.text[hits] + 1]
    near = np.zeros(len(weight), bool)
    near[hits] = seen[np.minimum(hits + NEAR + 1, b)] > seen[np.maximum(hits - NEAR, a)]
    top = np.zeros(n)
    np.maximum.at(top, words.text[hits], weight[hits])
    n_strong, n_weak = sums(strong), sums(weak)
    own = [n_strong / count, np.log1p(n_strong), n_weak / count, np.log1p(n_weak), sums(weight) / count, top, sums(near) / count, sums(person) / count]
    return np.concatenate([np.stack(own, axis=1), words.shape], axis=1).astype(np.float32)


class Trees:
    """Boosted trees of a fixed depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(m)], axis=1)
        rate = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.base)
        nodes = (1 << DEPTH) - 1
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            at = np.zeros(n, np.int64)
            for depth in range(DEPTH):
                first, width = (1 << depth) - 1, 1 << depth
                local = at - first
                best = np.zeros(width)
                for j in range(m):
                    bins = len(self.edges[j]) + 1
                    if bins == 1:
                        continue
                    key = local * bins + binned[:, j]
                    gl = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), axis=1)
                    hl = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                    gain[(hl < LEAF) | (ht - hl < LEAF)] = 0
                    k = gain[:, :-1].argmax(axis=1)
                    value = gain[np.arange(width), k]
                    better = np.flatnonzero(value > best + 1e-9)
                    best[better] = value[better]
                    feature[first + better] = j
                    cut[first + better] = self.edges[j][k[better]]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
            leaf = at - nodes
            values = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + RIDGE)
            margin += values[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(values)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function closest to the labels (pool adjacent violators), for linear reading."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x = np.array([m for b in blocks for m in (b[2], b[3])])
    return x, np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: pa.Array) -> np.ndarray:
        margin = self.trees.margin(features(words_of(texts), self.lexicon))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts (by hash of their ids) as ``doc_id``, ``text``, ``y``; their number bounds what is broadcast."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(keep).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(own), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> Model | float:
    """A model from the labelled rows for which ``keep`` holds; the rate of ones if there is nothing to learn from.

    ``docs`` has ``doc_id`` and ``text``. Reads at most ``TRAIN_ROWS`` whole texts.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    rows = scratch.write(labelled(docs, labels, label, keep).select("doc_id", "text", "y", fold.alias("fold")).repartition(12, "doc_id"), "train")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that have a term, by fold and label, added up in this task first."""
        found: dict[int, list] = {k: [] for k in range(2 * FOLDS)}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words = words_of(part.column("text"))
                for fold_, y, a, b in zip(part.column("fold").to_pylist(), part.column("y").to_pylist(), words.bounds[:-1], words.bounds[1:], strict=True):
                    found[2 * fold_ + (y > 0)].append(np.unique(words.terms[a:b]))
        for k, sets in found.items():
            if sets:
                terms, n = np.unique(np.concatenate(sets), return_counts=True)
                terms, n = terms[terms > 0], n[terms > 0]
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(n), k // 2, np.int32)), pa.array(np.full(len(n), k % 2, np.int32)), pa.array(n)], ["term", "fold", "y", "n"])

    per_fold = [[F.sum(F.when((F.col("fold") == k) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"c{y}_{k}") for k in range(FOLDS)] for y in (0, 1)]
    terms = rows.select("text", "y", "fold").mapInArrow(trimmed(count), "term long, fold int, y int, n long").groupBy("term").agg(*per_fold[0], *per_fold[1])
    terms = scratch.write(terms.filter(" + ".join(f"c1_{k}" for k in range(FOLDS)) + f" >= {SUPPORT}"), "terms")
    texts = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}

    def lexicon(without: int | None) -> Lexicon:
        folds = [k for k in range(FOLDS) if k != without]
        ones = sum((F.col(f"c1_{k}") for k in folds), F.lit(0))
        zeros = sum((F.col(f"c0_{k}") for k in folds), F.lit(0))
        n1, n0 = (sum(texts.get((y, k), 0) for k in folds) for y in (1, 0))
        odds = F.log((ones + 0.5) / (n1 + 1)) - F.log((zeros + 0.5) / (n0 + 1))
        z = odds / F.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
        best = terms.select("term", odds.alias("w"), z.alias("z")).filter((ones >= SUPPORT) & (odds >= WEAK) & (z >= 2.5)).orderBy(F.desc("z"), "term").limit(TERMS).collect()
        return Lexicon(np.array([r["term"] for r in best], np.int64).view(np.uint64), np.array([r["w"] for r in best], np.float32))

    others = [lexicon(k) for k in range(FOLDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, folds = words_of(part.column("text")), np.asarray(part.column("fold"))
                x = np.zeros((part.num_rows, FEATURES), np.float32)
                for k in np.unique(folds).tolist():
                    x[folds == k] = features(words, others[k])[folds == k]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("fold"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "fold", "x"])

    data = rows.mapInArrow(trimmed(describe), "doc_id long, y int, fold int, x binary").orderBy("doc_id").collect()
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in data])
    y, folds = np.array([r["y"] > 0 for r in data], np.float64), np.array([r["fold"] for r in data])
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        own = folds == k
        if own.any() and (~own).any():
            margin[own] = Trees(x[~own], y[~own]).margin(x[own])
    model = Model(lexicon(None), Trees(x, y), isotonic(margin, y))
    scratch.drop()
    return model


def score(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row; null texts are empty, repeated rows are scored each on its own."""
    spark = df.sparkSession
    prepare(spark)
    rows = text_rows(df, id_col, text_col)
    if isinstance(model, float):
        return rows.select("doc_id", F.lit(model).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text")))], ["doc_id", "score"])

    return rows.mapInArrow(trimmed(run), "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    Labels of held-out rows are never read. Null and empty texts are scored by their
    shape; without labels of both kinds every score is the rate of ones (0 without any).
    An empty table gives an empty result; other columns are not read.
    """
    model = fit(text_rows(documents, "doc_id", "text"), labels, "toxic", ~held_out("doc_id", folds, fold))
    return score(documents, model).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """The rows that score below one half, with all their columns; a rejected id takes all its rows along.

    A row without an id is judged by its own text.
    """
    model = fit(text_rows(documents, "doc_id", "text"), labels, "toxic", ~held_out("doc_id", folds, fold))
    rejected = score(documents.select(row_key().alias("doc_id"), "text"), model).filter("score >= 0.5").select("doc_id")
    return without(documents, Scratch(documents.sparkSession, "toxicity-gone").write(rejected.distinct(), "gone"))
