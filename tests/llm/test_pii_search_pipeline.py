"""Personal data against plain regular expressions, search against all pairs, and the pipeline stage by stage."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from driftline.llm import decontam, jaccard, pii, search, toxicity
from driftline.llm.common import Scratch
from driftline.llm.queries import QUERIES

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def check(rows, texts):
    """texts: list of (doc_id, text)."""
    want = sorted((str(d), hashlib.sha256(",".join(plain(x)).encode()).hexdigest()) for d, x in texts)
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    for r in rows:
        assert (r.n_email + r.n_ip + r.n_card + r.n_phone) <= len([s for s in r.spans.split(",") if s])


@pytest.mark.parametrize("size", [TINY, SF])
def test_base_spans(spark, size):
    texts = [tuple(r) for r in spark.read.parquet(f"{size}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op9_bootstrapped_pii"](spark, size).collect(), texts)


def test_base_spans_of_odd_texts(spark):
    rng = np.random.default_rng(5)
    alphabet = list("0123456789.@+- ()aB%é\n")
    texts = [(i, "".join(rng.choice(alphabet, int(rng.integers(0, 60))))) for i in range(3000)]
    texts += [(5000, None), (5001, ""), (5001, "a@b.c"), (None, "x 1.2.3.4 y"), (5002, "9" * 30_000), (5003, "a" * 50_000), (5004, "a.b" * 20_000 + "@c.d"), (5005, "x@" + "a." * 20_000 + "z"), (5006, "1.1.1." * 9000)]
    texts += [(5007, "é 😀 a@b.cc%dd@e.fg, +1 (555) 123-4567 and 4111 1111-1111 1111 1.2.3.4.5.6.7.8 001.02.3.255")]
    df = spark.createDataFrame([(d, x, "s", 1) for d, x in texts], "doc_id long, text string, spans string, base int")
    check(pii.personal_data(df).collect(), texts)
    assert pii.personal_data(df.limit(0)).count() == 0


def bootstrapped():
    """A context that only identifiers follow, and one that words follow as often."""
    rows = [(i, f"line {i}. hotline: +1 (555) 010-{1000 + i} for all") for i in range(8)]
    rows += [(100 + i, f"please use hotline: 555-777-{2000 + i} today") for i in range(3)]
    rows += [(200 + i, f"word{i * 7}x the +1 (555) 020-{1000 + i} and the end of the day") for i in range(8)]
    return rows + [(300, "about the 555-888-1234 thing"), (301, "hotline: closed")]


def test_patterns_find_unseen_identifiers(spark):
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(bootstrapped(), "doc_id long, text string")).collect()}
    for i in range(3):
        text = dict(bootstrapped())[100 + i]
        at = text.index("555")
        assert rows[100 + i].spans == f"phone:{at}:{at + 12}" and rows[100 + i].n_phone == 0
    assert rows[300].spans == "" and rows[301].spans == "" and rows[0].n_phone == 1


def test_unseen_identifiers_of_other_shapes(spark):
    """Planted behind contexts that seeds stand in: precision and recall of what is found."""
    long = "wort" * 18  # a context longer than the characters that are looked at first
    rows = [(i, f"x{i}a contact: a{i}@b.com and {long} 10.0.{i}.1 so") for i in range(6)]
    planted = {100: ("contact:", "DE89 3704 0044 0532", "email"), 101: ("contact:", "clara (at) host (dot) org", "email"), 102: ("contact:", "joe[at]host.org", "email"), 103: (long, "fe80:0:0:202:b3ff:1e83:29", "ip"), 104: (long, "10-20-30-40", "ip")}
    rows += [(i, f"see {context} {value}, then") for i, (context, value, _) in planted.items()]
    rows += [(200 + i, f"the {10**7 + i} of the and the") for i in range(6)] + [(300, f"in {10**9} of {long}"), (301, "order 2024-10-11 12:30:55 of the")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (context, value, kind) in planted.items():
        at = dict(rows)[i].index(value)
        assert got[i] == f"{kind}:{at}:{at + len(value)}", (i, got[i], context)
    assert not any(got[i] for i in got if i >= 200) and all(got[i].count(":") == 4 for i in range(6))


def test_masking_with_columns_of_like_names(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de", 5, 6, 7, 8, 9)], "doc_id long, text string, _hash int, spans_0 int, id_0 int, hash_0 int, Long_0 int")
    assert [tuple(r) for r in pii.masked(df).collect()] == [(1, "mail <EMAIL>", 5, 6, 7, 8, 9)] and pii.masked(df).columns == df.columns


def test_masking(spark):
    texts = [(1, "mail a.b@c.de or 1.2.3.4", "x", 0), (2, None, "y", 7), (1, "other 😀 +1 (555) 123-4567!", "z", 0), (None, "q@r.st", "n", 0), (3, "nothing", "m", 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, n_chars long")
    kept = pii.masked(df)
    assert kept.columns == df.columns
    got = {r.source: (r.text, r.n_chars) for r in kept.collect()}
    assert got["x"] == ("mail <EMAIL> or <IP>", 20) and got["z"] == ("other 😀 <PHONE>!", 16) and got["n"][0] == "<EMAIL>" and got["m"] == ("nothing", 7) and got["y"][0] is None


def test_runs_no_python(spark):
    plan = pii.personal_data(spark.read.parquet(f"{TINY}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def nearest(ids, x, q, k):
    scores = [(float(np.dot(x[i], x[q])), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
    return sorted(scores, key=lambda s: (-s[0], s[1]))[:k]


def recall(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float)
    found = {}
    for r in QUERIES["op10_adaptive_scan"](spark, path).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    place, hits, total = {int(i): n for n, i in enumerate(ids)}, 0, 0
    for query, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(abs(s - float(np.dot(x[place[v]], x[place[query]]))) < 1e-12 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({v for _, v, _ in got} & {v for _, v in nearest(ids, x, place[query], 20)})
        total += 20
    return hits / total


def test_recall(spark, monkeypatch):
    assert recall(spark, SF) >= 0.9
    monkeypatch.setattr(search, "START", 100)
    monkeypatch.setattr(search, "BLOCK_ROWS", 60)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 9)
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_search_of_odd_vectors(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)], 0) for i in range(12)] + [(20, None, 1), (21, [0.0, 0.0, 0.0], 1), (22, [1.0, None, 2.0], 1), (23, [float("nan"), 1.0, 2.0], 1), (24, [float("inf"), 1.0, 2.0], 1), (25, [1.0], 1), (3, [3.0, 1.0, 3.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = search.search(df, df.filter("vec_id % 20 = 0"), k=20).collect()
    assert {r.query_id for r in got} == {0} and sorted(r.vec_id for r in got) == list(range(1, 12))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [v for _, v in sorted(((-1.0, i) for i in range(1, 12)))]
    assert search.search(df.limit(0), df.limit(0)).count() == 0


def test_stages(spark):
    """Each stage by itself against what its operator says, and what the next one gets."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{TINY}/labels.parquet"), spark.read.parquet(f"{TINY}/benchmark.parquet")
    scratch, seen = Scratch(spark, "test"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(scratch.write(stage(spark, seen[-1], TINY), str(k)))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == ids[0] - {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert ids[2] == {r.component_id for r in jaccard.similarity_components(seen[1]).collect()}
    assert ids[3] == ids[2] - {r.doc_id for r in decontam.leaks(seen[2], benchmark).collect()}
    assert ids[4] == ids[3] == ids[5]
    assert all(d.columns == docs.columns for d in seen[:5])
    assert not [r for r in seen[4].collect() if plain(r.text)]
    whole = corpus_pipeline.run(spark, TINY)
    assert whole.columns == seen[5].columns and whole.count() == seen[5].count()
    assert whole.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`").count() == 0
