"""Personal data: fixed patterns, and identifiers found through the contexts that known ones stand in.

All of it is DataFrame operations. Base matches (the seeds) come from fixed patterns with
checks. Any other run of a text with enough digits, or with a spelt-out at-sign, is a
candidate, of no kind yet. The words to the left of seeds and candidates are patterns; a
pattern has the kinds of its seeds, and of the seeds that its candidates follow elsewhere.
Patterns and instances form a graph whose edges count how often an instance follows a
pattern. A pattern's score is the mass of reliable instances among all places where its
words occur, an unseen instance's score the chance that one of its patterns is right; both
are updated in turn. Candidates behind a pattern of high score and enough different
reliable instances become spans of its kind, whatever their own shape.

The places of a pattern are counted over all texts, but only for patterns that can still
reach the least score: the documents with instances, counted first, give a lower bound of
their places, so what the pass over all texts makes grows with the instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, fresh, small

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, different reliable instances that a pattern needs, and its least score.
ROUNDS, SUPPORT, LEAST_SCORE = 3, 3.0, 0.5
#: Most contexts that are held against a text's words as a set; more are joined.
CONTEXT_SET = 1_000
#: Characters left of an instance that are tried first, and where they don't hold two whole words; what is longer is no word of a pattern.
REACH, FAR = 64, 1_000
#: Digits of a candidate, and steps by which candidates hand kinds on.
DIGITS, STEPS = 5, 2

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns (fixed values). ``\\G`` or a look-behind starts them where a leftmost match can start, and
#: possessive repeats never try again what can't match, so a long run of one class costs one pass.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: a word with a digit and the groups of digits behind it, words around a spelt-out at-sign.
_WORD, _AT = r"[^\x20\x09-\x0D]", r"[(\[{][aA][tT][)\]}]"
LIKE = {
    "digits": rf"(?<!{_WORD})(?=[^0-9\x20\x09-\x0D]*+[0-9]){_WORD}++(?:\x20[(]?[0-9][0-9().:/,;-]*+(?!{_WORD}))*+",
    "at": rf"(?<!{_WORD})(?:(?!\x20?{_AT}){_WORD})++\x20?{_AT}\x20?{_WORD}++(?:\x20?[(\[{{][dD][oO][tT][)\]}}]\x20?{_WORD}++)*+",
}
#: Text that a match cannot do without: a cheap test before the patterns.
NEEDS = {"email": ("@", "@[A-Za-z0-9-]"), "ip": (".", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": ("", r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": ("+", r"\+[0-9]"), "digits": ("", "[0-9]"), "at": ("", _AT)}

SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def found(text: Column, pattern: str) -> Column:
    """All matches with their places: the texts between matches give the offsets, in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    places = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("skip"), F.length(v).alias("long"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["skip"] + x["long"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (acc["at"] + x["skip"] + x["long"]).alias("stop")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.zip_with(places, values, lambda p, v: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), v.alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second one doubled, less 9 above 9."""
    back = F.reverse(digits(value))
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.when(i % 2 == 0, doubled(F.substring(back, i, 1).cast("int"))).otherwise(F.substring(back, i, 1).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(13, 19) & luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    sign, needs = NEEDS[kind]
    matches = F.when(F.contains(text, F.lit(sign)) & F.rlike(text, F.lit(needs)), found(text, pattern))
    matches = F.filter(matches, lambda x: passes(kind, x["value"])) if kind in BASE else matches
    named = F.transform(matches, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))
    return F.coalesce(named.cast(SPAN), F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Base spans by kind as listed, then start."""
    return F.concat(*(_spans(text, kind, pattern) for kind, pattern in BASE.items()))


def like_spans(text: Column) -> Column:
    """Candidates without the quotes and brackets before and the signs behind them."""

    def trimmed(x: Column) -> Column:
        start = x["start"] + F.length(F.regexp_extract(x["value"], "^[\"'<\\[{]*", 0))
        stop = x["stop"] - F.length(F.regexp_extract(x["value"], "[^0-9A-Za-z]*$", 0))
        value = F.substring(x["value"], start - x["start"] + 1, stop - start)
        return F.struct(x["kind"].alias("kind"), start.alias("start"), stop.alias("stop"), value.alias("value"))

    of = lambda kind: F.transform(_spans(text, kind, LIKE[kind]), trimmed)
    return F.concat(of("at"), F.filter(of("digits"), lambda x: F.length(digits(x["value"])) >= DIGITS))


def of_kind(spans_: Column, kind: str) -> Column:
    return F.filter(spans_, lambda x: x["kind"] == kind)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _contexts(text: Column, start: Column) -> Column:
    """The last word, and the last two words, before a place: lower case, without digits."""
    left = lambda most: _backwards(F.substring(text, F.greatest(start - most + 1, F.lit(1)), F.least(start, F.lit(most))))
    cut = lambda words: F.when((F.size(words) > 2) | (start <= FAR), words).otherwise(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    whole = lambda words: F.when((F.size(words) > 2) | (start <= REACH), words).otherwise(_let(left(FAR), cut))

    def of(words: Column) -> Column:
        one, two = F.reverse(F.get(words, F.lit(0))), F.reverse(F.get(words, F.lit(1)))
        return F.filter(F.array(one, F.concat(two, F.lit(" "), one)), lambda w: w.isNotNull() & ~F.rlike(w, F.lit("[0-9]")))

    return _let(_let(left(REACH), whole), of)


def _backwards(left: Column) -> Column:
    """The last two words of a text and what stands before them, last first, each spelt backwards."""
    back = F.regexp_replace(F.reverse(F.lower(left)), "^[\"'(<\\[{]+", " ")
    return F.filter(F.split(F.regexp_replace(back, "^[\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+", 3), lambda w: w != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _places(words: Column) -> Column:
    """Every word, and every two words, as contexts are made."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


class Finder:
    """Base spans and discovered spans of one table; ``rows`` has ``row``, the id, ``base`` and ``more``."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        self.spark = df.sparkSession
        self.scratch = Scratch(self.spark, "pii")
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
        self.texts = docs
        like = F.filter(like_spans(F.col("text")), lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
        rows = docs.withColumn("base", base_spans(F.col("text"))).withColumn("like", like)
        context = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), _contexts(F.col("text"), x["start"]).alias("contexts"))
        rows = rows.withColumns({"base": F.transform("base", context), "like": F.transform("like", context)})
        words = F.when(F.size("base") + F.size("like") > 0, _words(F.col("text")))
        #: Spans, and the words of documents that have some, one row per document, in the order of nothing in particular.
        self.rows = self.scratch.write(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("long"), "base", "like", words.alias("words")), "rows")

    def graph(self) -> DataFrame:
        """``kind``, ``context``, ``value``, ``seed``, ``n``: how often each instance follows each pattern.

        Only patterns that some candidate stands behind as well (the others discover
        nothing), with enough instances for their support, whose places, as far as they
        are known, leave them the least score.
        """
        of = lambda column: self.rows.select(F.explode(column).alias("x")).select("x.kind", "x.value", F.explode("x.contexts").alias("context"))
        seeds = self.scratch.write(of("base").groupBy("kind", "context", "value").agg(F.count("*").alias("n")), "seeds")
        like = self.scratch.write(of("like").groupBy("context", "value").agg(F.count("*").alias("n")), "like")
        kinds = seeds.select("kind", "context").distinct()
        for _ in range(STEPS):
            edges = like.join(kinds, "context")
            kinds = kinds.unionByName(like.join(edges.select("kind", "value").distinct(), "value").select("kind", "context")).distinct()
        edges = seeds.withColumn("seed", F.lit(True)).unionByName(like.join(kinds, "context").withColumn("seed", F.lit(False)))
        edges = self.scratch.write(edges, "edges")
        able = edges.groupBy("kind", "context").agg(F.count("*").alias("instances"), F.min("seed").alias("closed"), F.sum("n").alias("mass")).filter((F.col("instances") >= SUPPORT) & ~F.col("closed"))
        able = self.scratch.write(able, "able")
        low = self.rows.filter("words IS NOT NULL").select(F.explode(_places(F.col("words"))).alias("context")).join(small(able.select("context").distinct()), "context", "left_semi").groupBy("context").agg(F.count("*").alias("low"))
        able = able.join(low, "context", "left").filter(F.col("mass") >= F.coalesce("low", F.lit(0)) * LEAST_SCORE).select("kind", "context")
        return edges.join(able, ["kind", "context"], "left_semi")

    def _counted(self, contexts: DataFrame) -> DataFrame:
        """``context``, ``places``: how often the words of each stand in all texts."""
        n = contexts.count()
        places = _places(_words(F.col("text")))
        if n <= CONTEXT_SET:
            wanted = [r["context"] for r in contexts.collect()]  # at most CONTEXT_SET
            return self.texts.select(F.explode(F.filter(places, lambda w: w.isin(wanted))).alias("context")).groupBy("context").agg(F.count("*").alias("places"))
        places = self.texts.select(F.explode(places).alias("context")).groupBy("context").agg(F.count("*").alias("places"))
        return places.join(small(contexts), "context", "left_semi")

    def patterns(self) -> DataFrame:
        """``kind``, ``context``, ``score`` and ``support`` of the patterns of high score."""
        edges = self.scratch.write(self.graph(), "graph")
        contexts = self.scratch.write(edges.select("context").distinct(), "contexts")
        if contexts.isEmpty():
            return self.spark.createDataFrame([], "kind string, context string, score double, support double")
        held = self.scratch.write(self._counted(contexts), "places")
        edges = edges.join(held, "context", "left").withColumn("places", F.greatest(F.coalesce("places", F.lit(0)), F.lit(1)))
        edges = self.scratch.write(edges, "counted")
        value = edges.select("kind", "value", "seed").groupBy("kind", "value").agg(F.max("seed").alias("seed")).withColumn("belief", F.col("seed").cast("double"))
        for k in range(ROUNDS):
            score = edges.drop("seed").join(value.select("kind", "value", "belief"), ["kind", "value"]).groupBy("kind", "context").agg(
                F.least(F.sum(F.col("n") * F.col("belief")) / F.max("places"), F.lit(1.0)).alias("score"), F.sum("belief").alias("support")
            )
            score = self.scratch.write(score, f"score-{k}")
            trusted = score.withColumn("score", F.when((F.col("support") >= SUPPORT) & (F.col("score") >= LEAST_SCORE), F.col("score")).otherwise(0.0))
            near = edges.join(trusted, ["kind", "context"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("told"))
            value = self.scratch.write(value.drop("belief").join(near, ["kind", "value"], "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0)))).drop("told"), f"value-{k}")
        return score.filter((F.col("support") >= SUPPORT) & (F.col("score") >= LEAST_SCORE))

    def spans(self) -> DataFrame:
        """``doc_id``, ``text_hash``, ``long``, ``base`` and ``more`` (discovered) spans of every document.

        A candidate behind patterns of several kinds is of the kind of the best one.
        """
        rows = self.rows.withColumn("row", F.monotonically_increasing_id())
        good = self.patterns().select("kind", "context", "score")
        like = rows.filter(F.size("like") > 0).select("row", F.explode("like").alias("x")).select("row", "x.start", "x.stop", "x.value", F.explode("x.contexts").alias("context"))
        hits = like.join(good, "context").groupBy("row", "start", "stop", "value").agg(F.max(F.struct("score", "kind")).alias("best"))
        hits = hits.select("row", F.struct(F.col("best.kind").alias("kind"), "start", "stop", "value").alias("s"))
        more = hits.groupBy("row").agg(F.collect_list("s").alias("more"))  # within one document
        plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"))).cast(SPAN)
        return rows.join(more, "row", "left").select("doc_id", "text_hash", "long", plain.alias("base"), F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN)).alias("more"))


def ordered(spans_: Column) -> Column:
    """Spans by kind as listed, then start, as ``kind:start:stop`` joined by commas."""
    parts = [F.array_sort(F.transform(of_kind(spans_, kind), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))) for kind in KINDS]
    return F.concat_ws(",", F.transform(F.concat(*parts), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, counts and digest of the base spans, and all ``spans``.

    Null texts are empty and have no spans (the digest is that of the empty string).
    Repeated rows and ids give a row each. Without any match nothing is learnt. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = Finder(df, id_col, text_col).spans()
    count = [F.size(of_kind(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *count, F.sha2(ordered(F.col("base")), 256).alias("base_sha256"), ordered(F.concat("base", "more")).alias("spans"))


def mask(text: Column, spans_: Column) -> Column:
    """The text with every span as its kind in angle brackets; of overlapping spans the first, then the longest, stays."""
    by_place = F.array_sort(F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))
    joined = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct((-x["back"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"))
        ),
    )
    done = F.struct(joined["at"].alias("at"), joined["out"].alias("out"))
    return F.when(F.size(spans_) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def masked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``df``, with personal data masked in the text and its length brought up to date.

    Null texts stay null. Rows are matched with their spans by id and text, so rows that
    repeat an id, even a null one, keep their own texts.
    """
    spans, id_, hash_, long_ = (fresh(df, stem) for stem in ("spans", "id", "hash", "long"))
    found_ = Finder(df, id_col, text_col).spans().select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("long").alias(long_), F.concat("base", "more").alias(spans)).filter(F.size(spans) > 0)
    found_ = small(Scratch(df.sparkSession, "pii-spans").write(found_.groupBy(id_, hash_, long_).agg(F.first(spans).alias(spans)), "spans"))
    text = F.col(f"`{text_col}`").cast("string")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(hash_)) & (F.length(text) == F.col(long_))
    rows = df.join(found_, same, "left")
    new = F.when(F.col(spans).isNull(), text).otherwise(mask(text, F.col(spans)))
    columns = [new.alias(c) if c == text_col else F.length(new).cast(df.schema[c].dataType).alias(c) if c == count_col else F.col(f"`{c}`") for c in df.columns]
    return rows.select(*columns)
