"""Set-similarity join of texts on word shingles, with adaptive multi-match prefixes.

Every document's distinct shingles are put in one global order, rare before frequent
(a count sketch over all documents, ties by hash). Documents of Jaccard similarity t or
more that are both cut to their first ``n - ceil(t n) + l`` shingles share at least l of
them. A longer prefix costs more postings and asks for more matches, so fewer candidates
reach verification; each document picks the l of least estimated cost, and a pair needs
the smaller l of its two documents.

Documents with equal sets are one class before the join. Links inside groups of near
copies are found first, by holding every posting against a few members of its list (one of
them the document with most shared shingles, so the likeliest centre of its group): work
linear in the postings. The join proper then only looks for pairs that these links don't
connect already. Short lists are joined as rows. Documents of long lists meet otherwise: sets
of like size that differ in d elements or fewer, dealt by hash into more than d parts, are
equal in one part at least, so they meet by (size band, part, hash of the part), which costs a
document rows in proportion to its set, not to the lists. Where even one part is common
to a long list of documents, that list is dealt out in blocks whose parity signatures are
held against each other (sets whose signatures differ in d bits differ in d elements or
more); only there the rows made grow with the square of a list, in steps of a block.

No list meets in one task unless it is short: lists are counted and their hubs chosen by
aggregations that combine first, and what is found goes back to the postings of long
lists by a broadcast (of checked size), to those of short ones by an exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import prepare, Scratch, small, text_rows, trimmed, without
from driftline.llm.shingles import SLICE_BYTES, mix, shingle_sets
from driftline.llm.tokens import slices
from driftline.operators.graph import components

#: Buckets of the count sketch: its size (4 MB) is the same for any input.
BUCKET_BITS = 20
#: Prefix extensions that a document may choose from.
EXTENSIONS = (1, 2, 3, 4)
#: Cost of verifying a candidate against that of reading a posting.
VERIFY_COST = 40.0
#: Members of each list that its postings are held against before the join proper.
HUBS = 3
#: Longest list joined as rows, rows of a block of a longer one, and bits of a signature at least.
SHORT_LIST, BLOCK, SIGNATURE = 32, 512, 1024
#: Most documents verified against one hub in one task, blocks that one row of a needed document names, bytes of sets in one batch.
STAR, NAMED, BATCH_BYTES = 256, 64, 8_000_000
#: Lists longer than this get what is found about them by a broadcast.
HOT_LIST = 1_000


def least_overlap(n: int, threshold: Fraction) -> int:
    """Fewest shared elements that a set of n needs with any partner."""
    return -((-n * threshold.numerator) // threshold.denominator)


def prefix(hashes: np.ndarray, counts: np.ndarray, base: float, threshold: Fraction) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set (in the global order) and its l."""
    n = len(hashes)
    if not n:
        return hashes, 0
    seen = counts[hashes >> np.uint64(64 - BUCKET_BITS)]
    order = np.lexsort((hashes, seen))
    one = n - least_overlap(n, threshold)
    most = min(n, one + EXTENSIONS[-1])
    first = order[:most]
    partners = np.cumsum(np.maximum(seen[first] - base, 0.0))
    best, chosen = math.inf, 1
    for extension in EXTENSIONS:
        if (size := one + extension) > n or extension > least_overlap(n, threshold):
            break
        cost = size + partners[size - 1] + VERIFY_COST * partners[size - 1] / extension
        if cost < best:
            best, chosen = cost, extension
    return hashes[first[: one + chosen]], chosen


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parities of the elements that fall on each bit, a bit for each element at least (a power of two), as 64-bit words.

    Sets whose signatures differ in d bits differ in d elements or more; a larger signature
    becomes a smaller one when its parts are taken together by exclusive or.
    """
    bits = max(SIGNATURE, 1 << max(len(hashes) - 1, 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def _count_sketch(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents have a shingle of each bucket, over all documents. The parts are summed as a tree."""
    width = 1 << (BUCKET_BITS - 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, held, n = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for x in shingle_sets(part.column("text"), size):
                    held.append((x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                    n += len(x)
                if n > 1 << BUCKET_BITS:
                    total += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
        yield _vectors(total, width, TaskContext.get().partitionId())

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for row in table.column("counts"):
            total += np.frombuffer(row.as_buffer(), "<i8") if len(row.as_buffer()) == 8 * width else np.frombuffer(row.as_buffer(), "<u2")
        data = total.astype("<u2") if total.max() < 1 << 16 else total.astype("<i8")
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "band": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([data.tobytes()], pa.binary())})

    schema = "piece int, band int, counts binary"
    vectors = rows.select("text").mapInArrow(trimmed(count), schema)
    for band in (F.expr("band div 128"), F.lit(0)):
        vectors = vectors.withColumn("band", band).groupBy("piece", "band").applyInArrow(add, schema)
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in vectors.collect():
        data = bytes(r["counts"])
        out[r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(data, "<i8" if len(data) == 8 * width else "<u2")
    return out


def _vectors(total: np.ndarray, width: int, band: int) -> pa.RecordBatch:
    parts = total.reshape(-1, width)
    data = [(x.astype("<u2") if x.max() < 1 << 16 else x.astype("<i8")).tobytes() for x in parts]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), band, np.int32)), pa.array(data, pa.binary())], ["piece", "band", "counts"])


def parts(hashes: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(band, hash) of each part of a set, for its own size band and the next.

    A band reaches from a size to that size over the threshold, so similar sets are in one
    band or in neighbours, and share the larger one's number. Two similar sets of at most
    m elements each differ in at most d of them, d the integer part of 2 m (1 - t) / (1 + t);
    of d + 1 + e parts by hash, e + 1 at least hold none of these. Where a set has at most
    e empty parts, one of those is not empty, so its empty parts, which many sets have in
    common, are left out.
    """
    p, q = threshold.numerator, threshold.denominator
    low, band, out = 1, 0, [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    n = len(hashes)
    while n and n * p > low * q:  # the band of n: its last size is low / t
        low, band = low * q // p + 1, band + 1
    for number in (band, band + 1) if n else ():
        most = low * q // p
        differ = 2 * most * (q - p) // (q + p)
        spare = differ // 10 + 1
        count = differ + 1 + spare
        deal = (mix(hashes ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes[order]))])
        ends = np.searchsorted(deal[order], np.arange(count + 1))
        held = np.flatnonzero(np.diff(ends))
        which = held if count - len(held) <= spare else np.arange(count)
        tag = (np.uint64(number) << np.uint64(40)) | which.astype(np.uint64)
        out.append((np.full(len(which), number, np.int32), mix(mix(total[ends[which + 1]] - total[ends[which]]) + tag).view(np.int64)))
        low = most + 1
    return np.concatenate([b for b, _ in out]), np.concatenate([h for _, h in out])


def _needed(rows: list[tuple]) -> pa.RecordBatch:
    hub, block, doc, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(block, pa.int32()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], ["hub", "block", "doc", "hashes"])


class Join:
    """The join's parts, over one table of texts; ``links`` and ``members`` are its results."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int, threshold: Fraction):
        self.spark, self.size, self.threshold = df.sparkSession, size, threshold
        prepare(self.spark)
        self.scratch = Scratch(self.spark, "jaccard")
        self.rows = text_rows(df, id_col, text_col)
        self.counts = self.spark.sparkContext.broadcast(_count_sketch(self.rows, size).astype(np.float32))
        self.sets = self.scratch.write(self._prefixes(), "sets")
        self.known = self.sets.filter("doc_id IS NOT NULL")
        copies = self.known.filter("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("held")).filter("held > 1").drop("held")
        self.copies = small(self.scratch.write(copies, "copies"))
        #: One row per document: size of its set and the smallest id with the same set.
        self.classes = self._classed(self.sets.select("doc_id", "key_a", "key_b", "n")).select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))

    def _classed(self, sets: DataFrame) -> DataFrame:
        return sets.join(self.copies, ["key_a", "key_b", "n"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))

    def _prefixes(self) -> DataFrame:
        counts, size, threshold = self.counts, self.size, self.threshold

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = counts.value
            base = float(np.median(table))
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    sets = shingle_sets(part.column("text"), size)
                    cuts = [prefix(x, table, base, threshold) for x in sets]
                    keys = [(np.bitwise_xor.reduce(x, initial=np.uint64(0)), np.add.reduce(mix(x ^ np.uint64(0x5BF03635))) if len(x) else np.uint64(0)) for x in sets]
                    signs = [signature(x) for x in sets]
                    sign_ends = np.cumsum([0, *map(len, signs)])
                    lengths = np.cumsum([0, *(len(p) for p, _ in cuts)])
                    flat = np.concatenate([p for p, _ in cuts]).view(np.int64) if lengths[-1] else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()),
                            pa.array(np.array([a for a, _ in keys], np.uint64).view(np.int64)), pa.array(np.array([b for _, b in keys], np.uint64).view(np.int64)),
                            pa.array([l for _, l in cuts], pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)),
                            pa.ListArray.from_arrays(pa.array(sign_ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *signs]))),
                        ],
                        ["doc_id", "n", "key_a", "key_b", "ell", "prefix", "sign"],
                    )

        return self.rows.mapInArrow(trimmed(cut), "doc_id long, n int, key_a long, key_b long, ell int, prefix array<long>, sign array<long>")

    def _with_lists(self, postings: DataFrame, lists: DataFrame, name: str) -> DataFrame:
        """Postings with the columns of their token's row in ``lists`` (which has ``held``); others go."""
        lists = self.scratch.write(lists, name)
        hot = lists.filter(F.col("held") > HOT_LIST)
        if hot.isEmpty():
            return postings.join(lists, "token")
        hot = small(hot)
        return postings.join(hot, "token").unionByName(postings.join(hot.select("token"), "token", "left_anti").join(lists, "token"))

    def _postings(self) -> DataFrame:
        """Prefix shingles that two classes or more have."""
        later = small(self.scratch.write(self._classed(self.known.select("doc_id", "key_a", "key_b", "n")).filter("doc_id <> class_id").select("doc_id", "key_a", "key_b").distinct(), "later"))
        postings = self.known.filter("n > 0").join(later, ["doc_id", "key_a", "key_b"], "left_anti").select(F.explode("prefix").alias("token"), "doc_id", "n", "ell")
        return self._with_lists(postings, postings.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1"), "lists")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        p, q = self.threshold.numerator, self.threshold.denominator
        return pairs.filter(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links, by the whole sets of their documents, made again from the texts.

        The end of a pair with more pairs is its hub. A hub's pairs are dealt out in blocks
        of bounded size; a document's set goes to the blocks it is needed in, straight from
        the scan of its text, so a pair costs one set in one exchange.
        """
        size, p, q = self.size, self.threshold.numerator, self.threshold.denominator
        pairs = self.scratch.write(self._plausible(pairs), f"plausible-{name}")
        degree = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("d"))
        ends = pairs.join(degree.select(F.col("doc").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("doc").alias("b"), F.col("d").alias("db")), "b")
        first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        stars = ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("doc"), F.when(first, F.col("da")).otherwise(F.col("db")).alias("d"))
        stars = stars.withColumn("block", F.pmod(F.xxhash64("doc"), F.ceil(F.col("d") / STAR)).cast("int"))
        needs = stars.select("doc", "hub", "block").unionByName(stars.select(F.col("hub").alias("doc"), "hub", "block").distinct())
        needs = self.scratch.write(needs, f"blocks-{name}")
        many = needs.groupBy("doc").agg(F.ceil(F.count("*") / NAMED).alias("rows"))
        needs = needs.join(many, "doc").withColumn("row", F.pmod(F.xxhash64("hub", "block"), F.col("rows"))).groupBy("doc", "row").agg(F.collect_list(F.struct("hub", "block")).alias("needs"))  # some NAMED a row
        needs = small(self.scratch.write(needs.drop("row"), f"needs-{name}"))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    held, held_bytes = [], 0
                    for doc, x, where in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), size), part.column("needs").to_pylist(), strict=True):
                        data = x.tobytes()
                        for w in where:
                            held.append((w["hub"], w["block"], doc, data))
                            held_bytes += len(data)
                            if held_bytes > BATCH_BYTES:
                                yield _needed(held)
                                held, held_bytes = [], 0
                    yield _needed(held)

        def hold(key: tuple, table: pa.Table) -> pa.Table:
            hub, sets = key[0].as_py(), {}
            for doc, x in zip(table.column("doc").to_pylist(), table.column("hashes"), strict=True):
                sets.setdefault(doc, []).append(np.frombuffer(x.as_buffer(), "<u8"))

            def similar(x: np.ndarray, y: np.ndarray) -> bool:
                both = len(np.intersect1d(x, y, assume_unique=True))
                return both * q >= (len(x) + len(y) - both) * p

            found = np.array([doc for doc, texts in sets.items() if doc != hub and any(similar(x, y) for x in sets.get(hub, []) for y in texts)], np.int64)
            return pa.table({"a": np.maximum(found, hub or 0), "b": np.minimum(found, hub or 0)})

        rows = self.rows.join(needs, self.rows["doc_id"] == needs["doc"]).select("doc_id", "text", "needs")
        sets = rows.mapInArrow(trimmed(whole), "hub long, block int, doc long, hashes binary")
        return self.scratch.write(sets.groupBy("hub", "block").applyInArrow(hold, "a long, b long"), f"found-{name}")

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures differ in no more bits than similar sets may differ in elements."""
        p, q = self.threshold.numerator, self.threshold.denominator
        side = lambda x: self.sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}"))
        words = F.least(F.size("sign_a"), F.size("sign_b"))

        def folded(sign: str):
            """A signature at the size of the smaller one: its parts, taken together by exclusive or."""
            parts = F.sequence(F.lit(1), F.expr(f"size({sign}) div least(size(sign_a), size(sign_b)) - 1"))
            start = F.slice(sign, 1, words)
            return F.when(F.size(sign) == words, F.col(sign)).otherwise(F.aggregate(parts, start, lambda acc, j: F.zip_with(acc, F.slice(sign, j * words + 1, words), lambda x, y: x.bitwiseXOR(y))))

        differ = F.aggregate(F.zip_with(folded("sign_a"), folded("sign_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(differ * (q + p) <= (F.col("n_a") + F.col("n_b")) * (q - p)).select("a", "b")

    def links(self) -> DataFrame:
        """Links between classes that connect all that are similar (``a`` > ``b``): each verified on whole sets."""
        postings = self.scratch.write(self._postings(), "postings")
        tried = self.scratch.write(self._hub_pairs(postings), "tried")
        found = self._verify(tried, "hubs")
        of = components(found, scratch=Scratch(self.spark, "jaccard-components"))
        now = postings.drop("held").join(of, postings["doc_id"] == of["node"], "left").select("token", "doc_id", "n", "ell", F.coalesce("component", "doc_id").alias("component"))
        now = self.scratch.write(now, "connected")
        lists = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).filter("lo < hi").select("token", "held")
        now = self.scratch.write(self._with_lists(now, lists, "open-lists"), "open")
        short = self._short(now.filter(F.col("held") <= SHORT_LIST))
        short = short.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("ell").alias("least")).filter("shared >= least").select("a", "b")
        long = now.filter(F.col("held") > SHORT_LIST)
        pairs = short if long.isEmpty() else short.unionByName(self._by_parts(long)).distinct()
        rest = self.scratch.write(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
        return found.unionByName(self._verify(rest, "rest"))

    def _hub_pairs(self, postings: DataFrame) -> DataFrame:
        """Every posting with a few members of its list."""
        if not HUBS:
            return postings.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
        degree = postings.groupBy("doc_id").agg(F.count("*").alias("degree"))
        order = [-F.col("degree"), *(F.xxhash64("doc_id", F.lit(k)) for k in range(1, HUBS))]
        hubs = [F.min(F.struct(o.alias("order"), "doc_id", "n")).alias(f"hub{k}") for k, o in enumerate(order)]
        lists = postings.join(degree, "doc_id").groupBy("token").agg(F.count("*").alias("held"), *hubs)
        lists = lists.select("token", "held", F.array_distinct(F.array(*(F.struct(F.col(f"hub{k}.doc_id").alias("doc_id"), F.col(f"hub{k}.n").alias("n")) for k in range(HUBS)))).alias("hubs"))
        pairs = self._with_lists(postings.drop("held"), lists, "hubs").select("doc_id", "n", F.explode("hubs").alias("hub")).select(
            F.greatest("doc_id", "hub.doc_id").alias("a"), F.least("doc_id", "hub.doc_id").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b")
        )
        return self._near(pairs).filter("a <> b").select("a", "b").distinct()

    def _by_parts(self, postings: DataFrame) -> DataFrame:
        """Pairs of documents of long lists that are of like size and equal in a part of their sets, and not connected yet."""
        size, threshold = self.size, self.threshold
        docs = small(self.scratch.write(postings.groupBy("doc_id").agg(F.max("component").alias("component")).withColumnRenamed("doc_id", "doc"), "long"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    for doc, of, x in zip(part.column("doc_id").to_pylist(), part.column("component").to_pylist(), shingle_sets(part.column("text"), size), strict=True):
                        band, hashes = parts(x, threshold)
                        n = len(hashes)
                        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(band, pa.int32()), pa.array([doc] * n, pa.int64()), pa.array([len(x)] * n, pa.int32()), pa.array([of] * n, pa.int64())], ["token", "ell", "doc_id", "n", "component"])

        rows = self.rows.join(docs, self.rows["doc_id"] == docs["doc"]).select("doc_id", "component", "text")
        met = self.scratch.write(rows.mapInArrow(trimmed(cut), "token long, ell int, doc_id long, n int, component long").distinct(), "parts")
        lists = met.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).filter("lo < hi").select("token", "held")
        met = self.scratch.write(self._with_lists(met, lists, "part-lists"), "open-parts")
        pairs = self._short(met.filter(F.col("held") <= SHORT_LIST)).select("a", "b")
        long = met.filter(F.col("held") > SHORT_LIST)
        return (pairs if long.isEmpty() else pairs.unionByName(self._long(long).select("a", "b"))).distinct()

    def _short(self, postings: DataFrame) -> DataFrame:
        """A row for each shingle that a pair not connected yet shares, of short lists."""
        side = lambda x: postings.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "ell", "component")))
        pairs = self._near(side("a").join(side("b"), "token").filter("doc_id_a > doc_id_b AND component_a <> component_b"))
        return pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"), F.least("ell_a", "ell_b").alias("ell"))

    def _long(self, postings: DataFrame) -> DataFrame:
        """The same of long lists, for pairs that their sizes and signatures leave possible."""
        p, q = self.threshold.numerator, self.threshold.denominator

        def meet(key: tuple, table: pa.Table) -> pa.Table:
            doc, n, ell, of, block = (table.column(c).to_numpy() for c in ("doc_id", "n", "ell", "component", "block"))
            signs = [np.array(x.values.to_numpy() if hasattr(x, "values") else x.as_py(), np.int64) for x in table.column("sign")]
            words = min(map(len, signs))
            short = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in signs])
            bits = np.unpackbits(short.view(np.uint8), axis=1).astype(np.float32)
            one, two = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
            weight = bits.sum(axis=1)
            differ = weight[one][:, None] + weight[two][None, :] - 2 * bits[one] @ bits[two].T
            sizes = n[one][:, None].astype(np.int64) + n[two][None, :]
            fit = np.minimum(n[one][:, None], n[two][None, :]) * q >= np.maximum(n[one][:, None], n[two][None, :]) * p
            fit &= (differ * (q + p) <= sizes * (q - p)) & (of[one][:, None] != of[two][None, :])
            i, j = np.nonzero(fit)
            i, j = one[i], two[j]
            if key[1].as_py() == key[2].as_py():
                i, j = i[doc[i] > doc[j]], j[doc[i] > doc[j]]
            return pa.table({"a": np.maximum(doc[i], doc[j]), "b": np.minimum(doc[i], doc[j]), "ell": np.minimum(ell[i], ell[j])})

        blocks = F.ceil(F.col("held") / BLOCK).cast("int")
        rows = postings.join(self.sets.select("doc_id", "sign"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "n", "ell", "component", "sign")
        return rows.groupBy("token", "i", "j").applyInArrow(meet, "a long, b long, ell int")

    def members(self) -> DataFrame:
        """``doc_id``, ``n_shingles``, ``class_id`` and ``component_id`` of every document."""
        own = self.classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
        twice = small(self.scratch.write(self.sets.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.col("doc_id").alias("a")), "twice"))
        own = own.join(twice, "a", "left_semi").distinct()  # a repeated id joins the classes of its texts
        of = components(self.links().unionByName(own), scratch=Scratch(self.spark, "jaccard-components"))
        rows = self.classes.join(of, self.classes["class_id"] == of["node"], "left")
        return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))


def similarity_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per document: size of its set, its class of equal sets, and its component of links.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words
    than ``size`` has all of them as its one shingle. Null and empty texts have an empty
    set, are linked with nothing and are their own component. Rows that repeat an id are one
    document, which links by any of its texts; rows without an id link with nothing and have no
    class or component. An empty table gives an empty result. Sets are compared by 64-bit
    hashes of their shingles.
    """
    return Join(df, id_col, text_col, size, threshold).members()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component; rows without an id stay.

    Of rows that repeat an id all stay or all go.
    """
    of = similarity_components(df, id_col, text_col, size, threshold)
    gone = Scratch(df.sparkSession, "jaccard-gone").write(of.filter("doc_id <> component_id").select("doc_id"), "gone")
    return without(df, gone, id_col, text_col)
