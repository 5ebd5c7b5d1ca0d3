"""The similarity join against all pairs."""

from fractions import Fraction

import pytest

from driftline.llm import jaccard
from driftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_sets(rows, size):
    out = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        out[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return out


def plain_components(sets, threshold):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * threshold.denominator >= len(x | y) * threshold.numerator:
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return {d: find(d) for d in docs}


@pytest.mark.parametrize("size_dir", ["sf0.001", "sf0.01"])
def test_components(spark, size_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size_dir}/documents.parquet").select("doc_id", "text").collect()]
    sets = plain_sets(rows, 4)
    got = QUERIES["op2_adaptive_jaccard_join"](spark, f"/root/testdata/{size_dir}").collect()
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(sets, Fraction(85, 100))


def near_copies():
    """Chains and stars of near copies around the threshold, and texts that share a passage only."""
    import random

    rng, rows = random.Random(5), []
    for group in range(6):
        base = [f"w{group}x{i}" for i in range(rng.choice([6, 20, 90]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(text)))
    passage = " ".join(f"p{i}" for i in range(40))
    for _ in range(30):
        rows.append((len(rows), passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 8, 30])))))
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "two words"), (1006, "x " * 50_000), (1007, "x " * 60_000)]


@pytest.mark.parametrize(
    ("threshold", "hubs", "short", "block"), [(Fraction(4, 5), 3, 32, 512), (Fraction(85, 100), 0, 2, 7), (Fraction(85, 100), 1, 2, 1000), (Fraction(1, 2), 0, 32, 512)]
)
def test_near_copies(spark, monkeypatch, threshold, hubs, short, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    monkeypatch.setattr(jaccard, "HOT_LIST", 20)
    monkeypatch.setattr(jaccard, "NAMED", 3)
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 500)
    rows = near_copies()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, token int")
    got = {r.doc_id: r.component_id for r in jaccard.similarity_components(df, size=5, threshold=threshold).collect()}
    assert got == plain_components(plain_sets(rows, 5), threshold)


def test_keeps_one_of_each_component(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other words", None), (None, "a b c d e f", "z"), (7, None, "n")], "doc_id long, text string, component_id string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (2, "other words"), (None, "a b c d e f"), (7, None)], key=str)
    assert jaccard.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(4, 5), Fraction(85, 100)])
def test_similar_sets_are_equal_in_a_part(threshold):
    import numpy as np

    rng = np.random.default_rng(7)
    t, met, made = float(threshold), 0, 0
    for n in [*range(1, 40), *rng.integers(40, 900, 60).tolist()]:
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(6):
            gone = int(rng.integers(0, n - int(np.ceil(t * n)) + 1))
            most = int((n - gone) / t - n)  # elements of its own that the other set may have
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, max(most, 0) + 1))).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if both * threshold.denominator >= (len(np.union1d(a, b))) * threshold.numerator:
                assert set(jaccard.parts(a, threshold)[1].tolist()) & set(jaccard.parts(b, threshold)[1].tolist())
                met += 1
        made = max(made, len(jaccard.parts(a, threshold)[1]) / n)
        other = rng.integers(0, 2**63, n).astype(np.uint64)
        assert n < 30 or t < 0.8 or not set(jaccard.parts(a, threshold)[1].tolist()) & set(jaccard.parts(other, threshold)[1].tolist())
    assert met > 300 and made <= 10  # rows of a document: in proportion to its set
    assert len(jaccard.parts(np.zeros(0, np.uint64), threshold)[0]) == 0


def test_rows_without_an_id(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 2, None), (4, 2, 2), (2, 2, 2), (None, 0, None)], key=str)


def test_signatures_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((50, 60), (1000, 1100), (3000, 5000)):
        a, b = (np.unique(rng.integers(0, 2**63, 2 * k).astype(np.uint64))[:k] for k in (n, m))
        b[: n // 2] = a[: n // 2]
        b = np.unique(b)
        x, y = jaccard.signature(a), jaccard.signature(b)
        words = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in (x, y))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_repeated_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f g"), (5, "x y z w q r s"), (7, "x y z w q r s"), (7, "x y z w q r s"), (9, "none of these words is there"), (11, None), (11, "")]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(5, 3, 5), (5, 3, 5), (7, 3, 5), (7, 3, 5), (9, 2, 9), (11, 0, 11), (11, 0, 11)]
    assert jaccard.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_link_by_each_text_in_any_order_of_ids(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    for five, seven, nine in ((5, 7, 9), (5, 9, 7), (7, 5, 9), (9, 7, 5), (7, 9, 5), (9, 5, 7)):
        rows = [(five, one), (seven, one), (seven, two), (nine, two + " more"), (1, "something else altogether stands in this text"), (seven, "")]
        got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, 1 if d == 1 else 5) for d, _ in rows)
