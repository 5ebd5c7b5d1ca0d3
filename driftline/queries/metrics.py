"""Accuracy, burden, telemetry and accounting over labels, events, lineitem and the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import metrics
from driftline.queries.common import table


def _micro(*names: str):
    return [F.rint(F.col(c) * 1e6).cast("long").alias(f"{c}_micro") for c in names]


def _sql_micro(**values: str) -> str:
    return ", ".join(f"CAST(round_even(({v}) * 1e6, 0) AS BIGINT) AS {k}_micro" for k, v in values.items())


def accuracy_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return metrics.accuracy(rows, F.col("quality") == 0, F.col("toxic") == 1).select("tp", "fp", "fn", *_micro("precision", "recall", "noise_ratio", "f1"))


def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.accuracy(rows, F.col("quality") == 0, F.col("toxic") == 1, ["source"]).select("source", "tp", "fp", "fn", *_micro("precision", "recall", "noise_ratio", "f1"))


def sheet_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"), F.col("o_orderpriority"))
    predicted = rows.select("a", "b", (F.col("o_orderpriority") == "5-LOW").alias("manual"))
    truth = rows.filter("a % 3 <> 0")
    return metrics.sheet_accuracy(predicted, truth, ["a", "b"], "manual").select("tp", "n_predicted", "n_truth", *_micro("precision", "recall", "f1"))


WORDS = ["confirmed", "TP ", "false_positive", "reject", "hold", "???"]


def review_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        metrics.decision(F.get(F.array(*map(F.lit, WORDS)), (F.col("l_suppkey") % len(WORDS)).cast("int"))).alias("decision"), F.col("l_linenumber").alias("rank"), F.col("l_orderkey").alias("sheet_id")
    )
    names = ("precision", "top_precision", "false_positive_per_sheet", "minutes_per_sheet")
    return metrics.burden(rows, 2).select("total_decisions", "confirmed", "false_positive", "hold", "sheets", "top_confirmed", "top_false_positive", *_micro(*names))


def perf_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", *_micro("p50", "p95", "p99"), F.rint(F.col("mean") * 1e4).cast("long").alias("mean_e4"), *_micro("peak"))


def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("key"))
    return metrics.cache_stats(rows, ["event_type"], F.col("value") < 50, "key").select("event_type", "hits", "misses", "duplicate_keys", F.rint(F.col("hit_rate") * 1e4).cast("long").alias("hit_rate_e4"))


def composition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with fewer customers than their requirement."""
    actual = table(spark, sf_dir, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    required = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7).cast("long").alias("least"))
    return metrics.shortfalls(actual, required, "n_nationkey")


def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "supplier").filter("s_acctbal < 500").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return metrics.zero_filled(counts, table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


def suppression_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_quantity") > 49).alias("a"), F.count_if(F.col("l_discount") > 0.5).alias("b"), F.count_if(F.col("l_tax") == 0).alias("c"))
    return metrics.audit(stats, {"a": "unsupported entities", "b": "block geometry skipped", "c": "cosmetic changes"})


def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    codes = F.array_compact(F.array(F.when(c("l_quantity") > 45, F.lit("OVERSIZE")), F.when(c("l_discount") > 0.08, F.concat(F.lit("DISCOUNT-"), c("l_returnflag"))), F.when(c("l_linenumber") > 5, F.lit("LATE"))))
    return metrics.failure_codes(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codes.alias("codes")).groupBy("l_orderkey", "l_linenumber").agg(F.max("codes").alias("codes")), "codes", ["l_orderkey", "l_linenumber"]).select("code", "n", "l_orderkey", "l_linenumber")


def quantity_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_linenumber").agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("side"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("centre"), F.sum("l_quantity").alias("total"))
    return metrics.accounting(rows, F.col("side"), F.col("centre"), F.col("total")).select("l_linestatus", "l_linenumber", "both_sides", "residual", "reconciles")


def golden_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("v"))
    golden = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 20).alias("v"))
    return metrics.reconcile(actual, golden, "o_custkey", "v", 3.0).groupBy("status").agg(F.count("*").alias("n"), F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))


QUERIES = {
    f.__name__: f
    for f in (accuracy_prf, accuracy_by_source, sheet_accuracy, review_burden, perf_percentiles, cache_statistics, composition_gate, zero_filled_counts, suppression_audit, failure_codes, quantity_accounting, golden_reconcile)
}

_PRF = _sql_micro(precision="tp / nullif(tp + fp, 0)", recall="tp / nullif(tp + fn, 0)", noise_ratio="fp / nullif(tp + fp, 0)", f1="2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0)")
_TPFPFN = "count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 0 AND toxic = 1) AS fn"
_RATIO = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 1.0::DOUBLE ELSE least(1, greatest(0, ({a}) / ({b}))) END"
_P, _R = _RATIO("tp", "n_predicted"), _RATIO("tp", "n_truth")

ORACLE_SQL = {
    "accuracy_prf": f"WITH n AS (SELECT {_TPFPFN} FROM labels) SELECT tp, fp, fn, {_PRF} FROM n",
    "accuracy_by_source": f"WITH n AS (SELECT source, {_TPFPFN} FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, tp, fp, fn, {_PRF} FROM n",
    "sheet_accuracy": f"""WITH r AS (SELECT o_custkey AS a, o_orderkey % 100 AS b, o_orderpriority AS o FROM orders), p AS (SELECT DISTINCT a, b FROM r WHERE o <> '5-LOW'), t AS (SELECT DISTINCT a, b FROM r WHERE a % 3 <> 0),
    n AS (SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM t) AS n_truth)
    SELECT tp, n_predicted, n_truth, {_sql_micro(precision=_P, recall=_R, f1=_RATIO(f"2 * {_P} * {_R}", f"{_P} + {_R}"))} FROM n""",
    "review_burden": f"""WITH d AS (SELECT CASE l_suppkey % 6 WHEN 0 THEN 'c' WHEN 1 THEN 'c' WHEN 2 THEN 'f' WHEN 3 THEN 'f' ELSE 'h' END AS d, l_linenumber AS r, l_orderkey AS s FROM lineitem),
    n AS (SELECT count(*) AS total_decisions, count(*) FILTER (d = 'c') AS confirmed, count(*) FILTER (d = 'f') AS false_positive, count(*) FILTER (d = 'h') AS hold, count(DISTINCT s) AS sheets,
      count(*) FILTER (d = 'c' AND r BETWEEN 1 AND 2) AS top_confirmed, count(*) FILTER (d = 'f' AND r BETWEEN 1 AND 2) AS top_false_positive FROM d)
    SELECT *, {_sql_micro(precision="confirmed / nullif(confirmed + false_positive, 0)", top_precision="top_confirmed / nullif(top_confirmed + top_false_positive, 0)", false_positive_per_sheet="false_positive / nullif(sheets, 0)", minutes_per_sheet="total_decisions * 0.5::DOUBLE / nullif(sheets, 0)")} FROM n""",
    "perf_percentiles": f"""SELECT event_type, count(*) AS n, {_sql_micro(p50="quantile_cont(value, 0.5)", p95="quantile_cont(value, 0.95)", p99="quantile_cont(value, 0.99)")}, CAST(round_even(avg(value) * 1e4, 0) AS BIGINT) AS mean_e4, {_sql_micro(peak="max(value)")}
    FROM events WHERE value >= 0 GROUP BY event_type""",
    "cache_statistics": """WITH v AS (SELECT event_type, value, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k FROM events)
    SELECT event_type, count(*) FILTER (value < 50) AS hits, count(*) FILTER (NOT value < 50) AS misses, count(k) - count(DISTINCT k) AS duplicate_keys,
      CAST(coalesce(round_even(count(*) FILTER (value < 50) / nullif(count(value), 0) * 1e4, 0), 0) AS BIGINT) AS hit_rate_e4 FROM v GROUP BY event_type""",
    "composition_gate": """WITH a AS (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1), r AS (SELECT n_nationkey, CAST(n_nationkey * 7 AS BIGINT) AS least, coalesce(n, 0) AS actual FROM nation LEFT JOIN a USING (n_nationkey))
    SELECT n_nationkey, "least", actual, "least" - actual AS missing FROM r WHERE actual < "least" """,
    "zero_filled_counts": "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal < 500) ON s_nationkey = n_nationkey GROUP BY n_nationkey",
    "suppression_audit": """WITH s AS (SELECT count(*) FILTER (l_quantity > 49) AS a, count(*) FILTER (l_discount > 0.5) AS b, count(*) FILTER (l_tax = 0) AS c FROM lineitem)
    SELECT label, n FROM (SELECT 'unsupported entities' AS label, a AS n FROM s UNION ALL SELECT 'block geometry skipped', b FROM s UNION ALL SELECT 'cosmetic changes', c FROM s) WHERE n > 0""",
    "failure_codes": """WITH l AS (SELECT l_orderkey, l_linenumber, max(list_filter([CASE WHEN l_quantity > 45 THEN 'OVERSIZE' END, CASE WHEN l_discount > 0.08::DOUBLE THEN 'DISCOUNT-' || l_returnflag END, CASE WHEN l_linenumber > 5 THEN 'LATE' END], lambda x: x IS NOT NULL)) AS codes FROM lineitem GROUP BY ALL),
    u AS (SELECT l_orderkey, l_linenumber, unnest(codes) AS code FROM l)
    SELECT code, count(*) AS n, min((l_orderkey, l_linenumber))[1] AS l_orderkey, min((l_orderkey, l_linenumber))[2] AS l_linenumber FROM u GROUP BY code""",
    "quantity_accounting": """WITH r AS (SELECT l_linestatus, l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS s, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS c, sum(l_quantity) AS t FROM lineitem GROUP BY ALL)
    SELECT l_linestatus, l_linenumber, s * 2 AS both_sides, t - s * 2 - c AS residual, abs(t - s * 2 - c) <= 1e-9 AS reconciles FROM r""",
    "golden_reconcile": """WITH a AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1), g AS (SELECT c_custkey AS o_custkey, c_custkey % 20 AS e FROM customer)
    SELECT CASE WHEN abs(e - v) <= 3 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(v) AS BIGINT) AS actual FROM g FULL JOIN a USING (o_custkey) GROUP BY 1""",
}
