"""Toxicity, quality, URL rules, decontamination and HTML against held-out labels and plain recomputation."""

import html
import re

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import decontam, htmltext, quality, toxicity, urls
from driftline.llm.queries import ORACLE_SQL, QUERIES, RULES
from tests.oracle import difference

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "You idiot " * 20_000), (4, "plain words here"), (4, "plain words here"), (None, "no id")]


def odd(spark, rows=TEXTS):
    return spark.createDataFrame([(i, x, "s", 1.0) for i, x in rows], "doc_id long, text string, label string, score double")


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity_trees", "toxic", 0.95), ("op8_subword_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("make", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(spark, make):
    label = "toxic" if make is toxicity.toxicity else "quality"
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (99, 1), (None, 1)], f"doc_id long, {label} int")
    assert make(odd(spark), labels).count() == len(TEXTS)
    none = make(odd(spark), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0} or max(r.score for r in none.collect()) < 1e-9
    assert make(odd(spark, []), labels).count() == 0


def test_keep_clean_keeps_columns(spark):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    bad, good = next(r.text for r in docs.collect() if r.doc_id in toxic), next(r.text for r in docs.collect() if r.doc_id not in toxic and r.text)
    nameless = spark.createDataFrame([(None, x, *[None] * 3) for x in (bad, good, None)], docs.schema)
    assert {r.text for r in toxicity.keep_clean(docs.unionByName(nameless), labels).filter("doc_id IS NULL").collect()} == {good, None}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(0)
    x, y = rng.random(200), (rng.random(200) < 0.5).astype(float)
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= -1e-12).all()
    fitted = np.interp(x, knots, values)[np.argsort(x)]
    ranked = y[np.argsort(x)]
    mean = lambda a, b: ranked[a : b + 1].mean()
    n = len(x)
    least = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(0, n, 7)]  # the least-squares fit, by its min-max form
    assert np.allclose(fitted[::7], least)


def test_a_tree_takes_the_best_split(monkeypatch):
    for name, value in (("TREES", 1), ("DEPTH", 1), ("LEAF", 0.5)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(2)
    x = rng.random((300, 3)).astype(np.float32)
    y = ((x[:, 1] > 0.6) ^ (rng.random(300) < 0.1)).astype(float)
    trees = toxicity.Trees(x, y)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    score = lambda own: g[own].sum() ** 2 / (h[own].sum() + toxicity.RIDGE)
    gains = {(j, float(c)): score(x[:, j] <= c) + score(x[:, j] > c) for j in range(3) for c in trees.edges[j]}
    j, c = max(gains, key=gains.get)
    assert trees.feature[0][0] == j and trees.cut[0][0] == pytest.approx(c)
    for side, own in ((0, x[:, j] <= c), (1, x[:, j] > c)):
        assert trees.leaf[0][side] == pytest.approx(-toxicity.RATE * g[own].sum() / (h[own].sum() + toxicity.RIDGE))
    assert np.allclose(trees.margin(x), trees.base + np.where(x[:, j] <= c, trees.leaf[0][0], trees.leaf[0][1]))


def test_quality_training_against_plain_steps(monkeypatch):
    """One text, one pass: the vectors and the output after a step of the softmax's gradient."""
    monkeypatch.setattr(quality, "EPOCHS", 1)
    which, share = quality.shares(pa.array(["good text of words"]))[0]
    assert share.sum() == pytest.approx(1) and len(set(which.tolist())) == len(which)
    gain, base = quality.train([(which, share)] * 2, np.array([1.0, 0.0]), seed=3)
    rng = np.random.default_rng(3)
    vectors = ((rng.random((1 << quality.BITS, quality.WIDTH), dtype=np.float32) - 0.5) / quality.WIDTH).astype(np.float64)
    output, bias = np.zeros((2, quality.WIDTH)), np.log(np.array([0.5, 0.5]) + 1e-3)
    for k, i in enumerate(rng.permutation(2).tolist()):
        step = quality.STEP * (1 - k / 2)
        hidden = share.astype(float) @ vectors[which]
        z = output @ hidden + bias
        p = np.exp(z) / np.exp(z).sum()
        p[[1, 0][i]] -= 1
        back = p @ output
        output, bias = output - step * np.outer(p, hidden), bias - 0.1 * step * p
        vectors[which] -= step / (share @ share) * share[:, None] * back
    assert np.allclose(gain[which], (vectors @ (output[1] - output[0]))[which], atol=1e-5) and base == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_url_rules_against_sql(spark):
    assert difference(spark, SF, QUERIES["op6_host_reputation"], ORACLE_SQL["op6_host_reputation"]) == ""


def test_url_parts_and_longest_rule(spark):
    rows = [
        (1, "http://a.Example.ORG/es/x?q"), (2, "https://example.org/en/1234"), (3, "x://shop.com/fr/"), (4, "x://shop.com"), (5, None), (6, "no scheme"), (7, "a://b://c/d"), (8, "http://notexample.org/es/"),
        (9, "http://evil.com/de/1"), (10, "http://evil.com/xx"), (10, "http://evil.com/xx"),
    ]
    rows += [(100 + i, f"http://evil.com/de/{i}") for i in range(60)] + [(200 + i, f"http://good{i}.com/fr/{i}") for i in range(60)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2].rule == "example.org/en/1" and got[2].verdict == "block"
    assert got[3].rule == "com/fr/" and got[4].rule is None and got[4].path == ""
    assert (got[5].host, got[6].host) == ("", "") and (got[7].host, got[7].path) == ("b:", "//c/d")
    assert got[8].rule == "org/" and got[8].verdict == "allow"
    assert got[10].rule is None and got[10].verdict == "block" and got[4].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def edit_distance(pattern, text):
    """Fewest edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_against_edit_distance():
    rng = np.random.default_rng(3)
    words = ["the", "and", "under", "stone", "river", "light", "carry", "quiet", "of", "mañana", "écho"]
    sentence = lambda n: " ".join(rng.choice(words, n))
    items = [(i, sentence(int(rng.integers(4, 60)))) for i in range(12)]
    windows = decontam.Windows.of(items)
    texts = [None, "", "short"]
    for i in range(60):
        body = list(items[i % 12][1])
        for _ in range(int(rng.integers(0, 14))):
            at = int(rng.integers(0, len(body)))
            body[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("abxyz "), int(rng.integers(0, 2))))
        texts.append(sentence(30) + "\n\n " + "".join(body).upper() + "  " + sentence(20))
    fold = lambda s: decontam.folded(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s.encode())]))[0].tobytes()
    found = {(t, item): (n, a, b, e) for t, item, n, a, b, e in decontam.matches(pa.array([x or "" for x in texts]), windows)}
    for t, text in enumerate(texts):
        low = fold(text or "")
        for item in range(12):
            own = np.flatnonzero(windows.item == item)
            edits = [edit_distance(windows.text[windows.at[w] : windows.at[w] + windows.size[w]].tobytes(), low) for w in own]
            fine = [e <= windows.budget[w] for e, w in zip(edits, own, strict=True)]
            got = found.get((t, item))
            assert (got[0] if got else 0) == sum(fine), (t, item, edits)
            if got:
                assert got[3] == min(edits) and 0 <= got[1] < got[2] <= len(text)


def test_leaks_by_any_part_of_an_item():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(2, 9, 600)]
    items = [(i, " ".join(rng.choice(words, 45))) for i in range(8)]
    texts = []
    for k in range(200):
        item, size = items[k % 8][1], (decontam.PART, 60, 75, 95, 110)[k % 5]
        at = int(rng.integers(0, len(item) - size + 1))
        texts.append(" ".join(rng.choice(words, 30)) + " " + item[at : at + size] + " " + " ".join(rng.choice(words, 30)))
    found = [(t, item) for t, item, *_ in decontam.matches(pa.array(texts), decontam.Windows.of(items))]
    assert found == [(k, k % 8) for k in range(200)]


def test_short_items_at_word_boundaries():
    items = [(1, "What is the capital of Peru?"), (2, "Who?"), (3, "seven"), (4, "日本の首都"), (5, "What is the capital of Chad?"), (6, " \n"), (7, "¿Qué es?")]
    texts = ["so: \"what  is the\ncapital of peru?\" he said", "whatever; seventy, eleven-seven", "これは日本の首都です", "xwhat is the capital of chad?", "", "seven", "“¿Qué es?”", "se", "ven"]
    found = list(decontam.matches(pa.array(texts), decontam.Windows.of(items)))
    assert [(t, items[i][0], n, e) for t, i, n, _, _, e in found] == [(0, 1, 1, 0), (1, 3, 1, 0), (2, 4, 1, 0), (5, 3, 1, 0), (6, 7, 1, 0)]
    assert [texts[t][a:b] for t, _, _, a, b, _ in found] == ["what  is the\ncapital of peru?", "seven", "日本の首都", "seven", "¿Qué es?"]


def test_leaks_that_differ_in_case_only():
    items = [(1, "Съешь же ещё этих мягких французских булок, да выпей чаю"), (2, "Ο γρήγορος σκύλος πηδά πάνω από τους τεμπέληδες φίλους"), (3, "été où l'élève préféré s'était égaré à côté de la forêt, là où naît l'été"), (4, "die große Straße führt außen um das weiße Schloß")]
    texts = ["ȺȺ Kelvin: " + x.upper() + " ẞ, İ" for _, x in items]
    found = list(decontam.matches(pa.array(texts), decontam.Windows.of(items)))
    assert {(t, i, e) for t, i, _, _, _, e in found} == {(k, k, 0) for k in range(4)}
    assert all(texts[t][a:b] == items[i][1].upper() for t, i, _, a, b, _ in found if i != 1)
    for text in [*texts, "", "a", "ÀÈ \n Σς", "ﬁ ŉ ǰ ΐ"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        low, ends, at = decontam.folded(raw, np.array([0, len(raw)]))
        assert low.tobytes().decode() == re.sub(r"[ \n]+", " ", text.casefold())
        assert ends.tolist() == [0, len(low)] and len(at) == len(low) and (np.diff(at) >= 0).all()


def test_leaks_on_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    fold = lambda s: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), s).split())
    found = {(r.doc_id, r.item_id) for r in QUERIES["op7_qgram_decontamination"](spark, SF).collect()}
    assert found >= {(d, i) for d, text in docs.items() for i, item in items.items() if fold(item) in fold(text)}
    benchmark = spark.createDataFrame([(1, None), (2, "tiny"), (3, "a passage that is long enough to be looked for in texts")], "item_id long, text string")
    rows = odd(spark, [*TEXTS, (9, "x A  Passage that is long\nenough to be looked for in texts y"), (9, "clean")])
    assert [(r.doc_id, r.item_id, r.edits) for r in decontam.leaks(rows, benchmark).collect()] == [(9, 3, 0)]
    kept = decontam.keep_unleaked(rows, benchmark)
    assert kept.columns == rows.columns and kept.count() == len(TEXTS)
    gone = odd(spark, [(None, "a passage that is long enough to be looked for in texts"), (None, "clean"), (None, None), (1, "clean")]).withColumnRenamed("label", "gone_0").withColumnRenamed("score", "own_0")
    assert [r.text for r in decontam.keep_unleaked(gone, benchmark).orderBy("doc_id", "text").collect()] == [None, "clean", "clean"]
    assert decontam.leaks(rows, benchmark.limit(0)).count() == 0 and decontam.leaks(rows.limit(0), benchmark).count() == 0


def test_benchmark_in_parts(spark, monkeypatch):
    whole = {tuple(r) for r in QUERIES["op7_qgram_decontamination"](spark, TINY).collect()}
    monkeypatch.setattr(decontam, "PASS_BYTES", 1000)
    assert {tuple(r) for r in QUERIES["op7_qgram_decontamination"](spark, TINY).collect()} == whole


def test_articles_of_pages(spark):
    got = {r.page_id: r for r in QUERIES["op5_host_suffix_array"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = p.html[p.html.index("<article>") : p.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1|article)[^>]*>", body)]
        text = "\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)


PAGE = """<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice"><p>We use cookies</div><main><header><h1>Head &amp; line</h1></header><p>One&nbsp;two   three<br>four<p class=ad>Buy</p><!-- <p>no</p> --><form><p>mail</form>
<div id="comments"><p>first!</p></div><p>5 < 6 &lt; 7</main><aside>side</aside><footer>foot</footer></body>"""


def test_blocks_by_role():
    found = htmltext.blocks(PAGE)
    assert [t for r, t in found if r == "main"] == ["Head & line", "One two three four", "5 < 6 < 7"]
    assert not [t for r, t in found if r == "open" and t != "Site"]
    assert htmltext.blocks("<article><p class=ad>Buy<p>text<ul><li class='ad'><div>no</div>no<li>yes</ul><p>end") == [("chrome", "Buy"), ("main", "text"), ("chrome", "no"), ("chrome", "no"), ("main", "yes"), ("main", "end")]
    assert htmltext.blocks("") == [] and htmltext.blocks("<p>a<script>x") == [("open", "a")] and htmltext.blocks("a <b") == [("open", "a")]


def test_marks_inside_an_article():
    of = lambda page, role: [t for r, t in htmltext.blocks(page) if r == role]
    kept = "<section id='related-work'><p>one</section><h2 id='comments'>two</h2><div class='social-history'>three</div><p class='notice'>four</p><div class=search-results>five</div><p>six <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math></p>"
    assert of(f"<article>{kept}</article>", "main") == ["one", "two", "three", "four", "five", "six x=2"]
    gone = "<div class='related-posts'>a</div><div class='post-comments wide'>b</div><div class=cookie-notice>c</div><div id=comments>d</div><div class='share-buttons'>e</div><p class=ad>f</p>"
    assert of(f"<article>{gone}g</article>", "main") == ["g"]
    page = "<article>own<section class='comments'><article class='comment'><p>first</p></article><article>second</article></section><article class='comment' id='comment-7'>third<article>fourth</article></article> text</article><article class='post comments-open'>more</article>"
    assert of(page, "main") == ["own", "text", "more"] and of(page, "chrome") == ["first", "second", "third", "fourth"]
    assert of("<section class=comments><article>no</article></section><article>yes</article>", "main") == ["yes"]
    assert of("<nav>menu<article>yes</article>", "main") == ["yes"]


def test_repeated_substrings_go_unique_runs_stay(spark):
    chrome = "<div><p>all rights reserved by the example news company of nowhere</div>"
    rows = [(i, f"http://h.com/{i}", f"<body>{chrome}<p>story number {i} tells of something quite its own{i}</p>{chrome}") for i in range(6)]
    rows += [(50, "http://other.com/", rows[0][2]), (51, None, None), (52, "http://h.com/z", ""), (52, "http://h.com/z", "")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story number {i} tells of something quite its own{i}" for i in range(6))
    assert "all rights" in got[50] and got[51] == "" and got[52] == ""
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def host_pages(n=40):
    """Pages of two hosts without an article element or telling class words: (id, url, html, text)."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(k))) for k in rng.integers(2, 9, 900)]
    sentence = lambda k: " ".join(rng.choice(words, k))
    out = []
    for host in ("a.example.com", "b.example.com"):
        head, foot, short, note = sentence(12), sentence(30), "Read more here", sentence(15)
        for i in range(n):
            story = [sentence(int(rng.integers(4, 60))) for _ in range(int(rng.integers(1, 6)))]
            mixed = sentence(20)
            body = f"<div>{head}</div><p>{short}</p>" + "".join(f"<p>{s}</p>" for s in story) + f"<p>{note} {mixed}</p><div>{foot} {i}</div>"
            out.append((len(out), f"http://{host}/{i}", f"<html><body>{body}</body></html>", "\n".join([*story, mixed])))
    return out


def test_pages_without_an_article(spark, monkeypatch):
    pages = host_pages()
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    monkeypatch.setattr(htmltext, "HOT_PAGES", 20)
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    right = found = wanted = 0
    for i, _, _, text in pages:
        a, b = got[i].split(), text.split()
        found, wanted = found + len(a), wanted + len(b)
        right += sum(min(a.count(w), b.count(w)) for w in set(b))
    assert right / found >= 0.95 and right / wanted >= 0.95
    assert np.mean([got[i] == text for i, _, _, text in pages]) >= 0.95
    monkeypatch.setattr(htmltext, "PAGES", 10**6)  # nothing repeats often enough: the array is off
    off = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert all(off[i] != got[i] and "Read more here" in off[i] for i in off)


def test_covered_tokens_against_all_pairs():
    """What the ranks cover is what any substring of LENGTH tokens or more, on PAGES distinct streams, covers."""
    rng = np.random.default_rng(8)
    phrase = [" ".join(rng.choice(list("uvwxyz"), 11)) for _ in range(3)]
    pages = [[" ".join([*rng.choice(list("abcde"), int(rng.integers(0, 6))), phrase[int(rng.integers(0, 3))], *rng.choice(list("abcde"), int(rng.integers(0, 6)))]) for _ in range(3)] for _ in range(9)]
    held = [set(np.concatenate(htmltext.beginnings(p)[1:]).tolist()) for p in pages]
    count = {r: sum(r in h for h in held) for h in held for r in h}
    repeated = np.array([r for r, n in count.items() if n >= htmltext.PAGES], np.uint64)
    streams = [f" {k} ".join(p).split() for k, p in enumerate(pages)]  # what stands between blocks is on one page only
    for p, stream in zip(pages, streams, strict=True):
        covered = [False] * len(stream)
        for i in range(len(stream)):
            for j in range(i + htmltext.LENGTH, len(stream) + 1):
                piece = stream[i:j]
                if sum(any(s[k : k + len(piece)] == piece for k in range(len(s))) for s in streams) >= htmltext.PAGES:
                    covered[i:j] = [True] * (j - i)
        whole = {b for b in p if sum(b in q for q in pages) >= htmltext.PAGES}
        want, at = [], 0
        for b in p:
            own = covered[at : at + len(b.split())]
            at += len(own) + 1
            if b in whole:
                continue
            runs, run = [], []
            for w, c in zip([*b.split(), None], [*own, True], strict=True):
                if not c:
                    run.append(w)
                elif run:
                    runs, run = [*runs, run], []
            least = htmltext.SCRAP if any(own) and sum(own) >= htmltext.COVERED * len(own) else 1
            want += [" ".join(r) for r in runs if len(r) >= least]
        assert htmltext.kept(p, repeated) == want


def test_lines_of_all_articles_of_a_host_go(spark, monkeypatch):
    """What most pages of a host have in their articles is no text of theirs; what some share, and what copies of one page share, is."""
    line, some = "all rights reserved by the example news company of nowhere", "a proverb that several of the stories like to tell again and again"
    own = lambda i: f"story number {i} tells of something quite its own{i}"
    page = lambda i: f"<article><p>{own(i)} {line}</p><p>{some if i % 2 else own(-i)}</p><p>Read more</p></article>"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(20)] + [(20, "http://h.com/", f"<article>{own(20)}</article>"), (21, "http://h.com/", f"<div>{line}</div>")]
    rows += [(100 + i, "http://few.com/", page(i)) for i in range(7)] + [(200 + i, "http://copies.com/", page(1 if i < 50 else 1000 + i)) for i in range(55)]
    rows += [(300 + i, "http://apart.com/", page(i) if i < 8 else f"<article>{own(i)}</article>") for i in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole = lambda i: f"{own(i)} {line}\n{some if i % 2 else own(-i)}\nRead more"
    for most in (2_000_000, 30):
        monkeypatch.setattr(htmltext, "GROUP_RANKS", most)
        got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
        assert len(got) == len(rows) and all(got[i] == f"{own(i)}\n{some if i % 2 else own(-i)}" for i in range(20))
        assert got[20] == own(20) and all(got[100 + i] == whole(i) for i in range(7)) and all(got[200 + i] == whole(1 if i < 50 else 1000 + i) for i in range(55))
        assert all(got[300 + i] == (whole(i) if i < 8 else own(i)) for i in range(16))


def test_class_words_are_whole_tokens(spark):
    of = lambda page, role: [t for r, t in htmltext.blocks(page) if r == role]
    assert of("<div class='content no-sidebar'><p>story body</p></div><div class=share-price>up</div>", "open") == ["story body", "up"]
    assert of("<div class='sidebar-left'>a</div><div id=site-header>b</div><div role=contentinfo>c</div><div class='page-footer dark'>d</div>", "chrome") == ["a", "b", "c", "d"]
    assert of("<p>İstanbul</p><SCRIPT>x</p></SCRIPT><p>after text</p>", "open") == ["İstanbul", "after text"]


def test_long_pages_and_columns_of_like_names(spark):
    story = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "http://h.com/" + "x" * 50_000, f"<p>{story}</p>", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row int").withColumn("host", pytest.importorskip("pyspark.sql.functions").lit("z"))
    r = htmltext.extract(df).first()
    assert r.text == story and r.n_chars == len(story)
    judged = urls.judge(df.withColumns({c: df["row"] for c in ("path", "rule", "verdict", "said", "suffix", "domain", "alpha", "m", "n", "k")}), RULES).first()
    assert judged.host == "h.com" and judged.path == "/" + "x" * 50_000 and judged.verdict == "allow"


def test_ranks_mark_equal_beginnings():
    tokens = np.random.default_rng(0).integers(0, 3, 200).astype(np.uint64)
    rank = htmltext.ranks(tokens)
    for i in range(len(rank)):
        for j in range(i):
            assert (rank[i] == rank[j]) == (tokens[i : i + 8] == tokens[j : j + 8]).all()


